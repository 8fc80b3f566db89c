"""Line deduplication over levelled sorted runs of line hashes.

The corpus arrives in batches of ascending doc_id.  A run is a table of
(hash, owner) in buckets of the hash, each one file in hash order.  Each batch
reduces its lines to the smallest document of each hash, merge-joins these with
the runs so far, which are neither shuffled nor sorted for it, and keeps what no
run holds as a new run of level 0 (the anti join); hashes that a run holds belong
to that run's owner, a smaller doc_id.  When a level has `fan_in` runs they are
merged bucket by bucket into one of the next level, so a batch reads a logarithmic
number of runs and a hash is rewritten once a level.

What a batch finds repeated, inside it or in a run, goes with its owner into a
table of repeated hashes.  In the end a document loses the lines whose hash is
there under another owner.  Lines are hashed to 128 bits; the hashes
of each document are written once, by batch, and the texts move once, to meet
their lost hashes.  Hot lines are reduced before they are shuffled and stand once
in the table of repeated hashes; the join of the documents' hashes with it is a
sort-merge join whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm.common import drop_path, fresh_path, numbered, with_fields, without

SPACE = b" \t\n\x0b\x0c\r"


def line_hashes(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines in UTF-8, and for each the 16-byte hash of its key, None for keys of less than min_chars code points."""
    lines = (text or "").encode().split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        hashes.append(xxhash.xxh3_128_digest(key.lower()) if long else None)
    return lines, hashes


def _hash_rows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2) of the different hashes of each row."""
    for batch in batches:
        found, n = [], []
        for text in batch.column(1):
            own = set(line_hashes(text.as_py(), min_chars)[1]) - {None}
            found += sorted(own)
            n.append(len(own))
        h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "h1", "h2"])


@contextlib.contextmanager
def _ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Inside, scans of buckets of one file each count as sorted; Spark checks the files and sorts where there are more."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LevelledRuns:
    """Sorted runs in the shared folder: tables of sorted buckets of (h1, h2), owner, and known, which is null in rows that the run itself owns."""

    def __init__(self, spark: SparkSession, fan_in: int = 3):
        self.spark, self.fan_in = spark, fan_in
        # as many buckets as a shuffle has partitions: a batch that is reduced by hash meets them as it lies
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def _rows(self, table: str) -> DataFrame:
        return self.spark.table(table).where(F.col("known").isNull()).select("h1", "h2", "owner")

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_path(self.spark, self._paths.pop(table))

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def met(self, rows: DataFrame) -> DataFrame:
        """rows, which have each hash once, with known: the owner that a run has for it, by a merge join with each run."""
        found = rows
        for k, table in enumerate(self.tables()):
            found = found.join(self._rows(table).withColumnRenamed("owner", f"__aw_owner{k}").hint("merge"), ["h1", "h2"], "left")
        # no hash is owned by two runs
        known = [F.col(f"__aw_owner{k}") for k in range(len(self.tables()))]
        return found.select(*rows.columns, F.coalesce(*known, F.lit(None).cast("long")).alias("known"))

    def add(self, rows: DataFrame, level: int = 0) -> DataFrame:
        """rows (h1, h2, owner, known and further columns), each hash once, as a new run; the rows as written, to be read before anything else is added."""
        path, table = fresh_path(self.spark, f"run{level}"), f"arcwell_run_{uuid.uuid4().hex}"
        self._paths[table] = path
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).format("parquet").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        return self.spark.table(table)

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next."""
        for level in range(len(self.levels) + 1):
            if level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
                merged, self.levels[level] = self.levels[level], []
                # hashes differ: the aggregate only asks that equal ones lie together, which buckets do
                rows = functools.reduce(DataFrame.unionByName, map(self._rows, merged)).groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
                self.add(rows.withColumn("known", F.lit(None).cast("long")), level + 1)
                for table in merged:
                    self._drop(table)

    def clear(self) -> None:
        for table in list(self._paths):
            self._drop(table)
        self.levels = []


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fan_in: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) of every document, and (h1, h2, owner) of the keys of two documents or more.

    Batches are cut at quantiles of doc_id, whatever range the ids span; how many there
    are and where exactly they are cut changes no result.
    """
    spark = docs.sparkSession
    at = fresh_path(spark, "lines")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], 10_000)).first()[0]
    each = rows.mapInArrow(lambda b: _hash_rows(b, min_chars), "doc_id long, h1 long, h2 long")
    batch = sum(((F.col("doc_id") > F.lit(x)).cast("int") for x in (edges or ())[: batches - 1]), F.lit(0))
    each.withColumn("batch", batch).write.partitionBy("batch").parquet(at)
    lines = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(at)
    runs, again = LevelledRuns(spark, fan_in), fresh_path(spark, "repeated")
    try:
        with _ordered_scans(spark):
            for batch in range(batches if edges else 0):
                first = lines.where(F.col("batch") == batch).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
                run = runs.add(runs.met(first))
                run.where(F.col("known").isNotNull() | (F.col("last") > F.col("owner"))).select("h1", "h2", F.coalesce("known", "owner").alias("owner")).write.mode("append").parquet(again)
                if batch < batches - 1:
                    runs.compact()
    finally:
        runs.clear()
    if not edges:
        spark.createDataFrame([], "h1 long, h2 long, owner long").write.parquet(again)
    return lines.select("doc_id", "h1", "h2"), spark.read.schema("h1 long, h2 long, owner long").parquet(again).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped.

    A key of at least min_chars code points that two documents or more hold keeps
    its lines only in the smallest doc_id, all of them if it repeats there.  A null
    text counts as one empty line and comes back as an empty text.  Rows with one
    doc_id count as one document.  Rows whose doc_id is null neither own nor lose
    lines.  Columns of docs named like the three that are added are replaced.
    """
    docs = without(docs, "kept_text", "n_lines", "n_dropped")
    lines, owners = repeated_lines(docs, min_chars, batches, fan_in)
    lost = lines.join(owners, ["h1", "h2"]).where(F.col("doc_id") != F.col("owner")).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__aw_lost"))
    return rebuilt(docs, lost, min_chars)


def rebuilt(docs: DataFrame, lost: DataFrame, min_chars: int) -> DataFrame:
    """docs without the lines whose hashes are in `__aw_lost` of their doc_id, as kept_text, with the counts of lines."""
    names = docs.columns
    met = docs.join(lost.withColumnRenamed("doc_id", "__aw_id"), F.col("doc_id").cast("long") == F.col("__aw_id"), "left")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, dropped = [], [], []
            for text, gone in zip(batch.column(at), batch.column(len(names))):
                lines, hashes = line_hashes(text.as_py(), min_chars)
                away = {h["h1"].to_bytes(8, "little", signed=True) + h["h2"].to_bytes(8, "little", signed=True) for h in gone.as_py() or ()}
                stay = [x for x, h in zip(lines, hashes) if h not in away] if away else lines
                kept.append(b"\n".join(stay).decode())
                n.append(len(lines))
                dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], [*names, "kept_text", "n_lines", "n_dropped"])

    return met.select(*numbered(names), "__aw_lost").mapInArrow(run, with_fields(docs, "kept_text string, n_lines long, n_dropped long"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), owners AS (
    SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10
    GROUP BY k HAVING count(DISTINCT doc_id) > 1
)
SELECT keyed.doc_id AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE owner IS NOT NULL AND owner <> keyed.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner = keyed.doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owners ON keyed.k = owners.k
GROUP BY keyed.doc_id
"""
