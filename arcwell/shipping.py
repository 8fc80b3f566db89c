"""The package on the executors, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()

#: Most that a batch between the JVM and a Python worker holds; several copies of one live in a worker at a time.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the Python workers of an application, once, and bounds the batches that these get."""
    context = spark.sparkContext
    session = spark._jsparkSession.sessionUUID()
    if session not in _done:
        _done.add(session)
        for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
            if not context.getConf().contains(key):
                spark.conf.set(key, str(value))
    if context.applicationId in _done:
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="arcwell-")) / "arcwell.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    context.addPyFile(str(at))
    _done.add(context.applicationId)
