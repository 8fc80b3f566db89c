"""What several operators share: the cluster's folder, cutting lineage, and names that clash with none."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of tables, the innermost last; only the driver's thread that builds plans uses them.
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset and all run in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="arcwell-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder; removed when the driver ends."""
    at = f"{shared_dir(spark)}/arcwell-{spark.sparkContext.applicationId}"
    if at not in _application_dirs:
        _application_dirs.add(at)
        atexit.register(_drop_quietly, spark, at)
    return at


_application_dirs: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_scopes[-1] if _scopes else _application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside go when it ends: whatever was read from them must have been written elsewhere by then."""
    _scopes.append(fresh_path(spark, "scope"))
    try:
        yield
    finally:
        drop_path(spark, _scopes.pop())


def kept(df: DataFrame, name: str = "kept", path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table of ours that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        drop_path(spark, path)


def without(docs: DataFrame, *made: str) -> DataFrame:
    """docs without the columns that an operator adds under these names: its own take their place.

    Names that begin with two underscores and `aw` are the operators' own.
    """
    return docs.drop(*[c for c in made if c in docs.columns])


def numbered(names: list[str]) -> list[Column]:
    """The columns of these names, whatever is in them, under numbers: Arrow functions refuse names with dots."""
    return [F.col("`" + n.replace("`", "``") + "`").alias(f"__aw_c{k}") for k, n in enumerate(names)]


def with_fields(docs: DataFrame, more: str) -> StructType:
    """The schema of docs and further fields."""
    return StructType(docs.schema.fields + StructType.fromDDL(more).fields)
