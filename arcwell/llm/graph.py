"""Connected components by alternating large-star and small-star steps.

Edges only, no collected neighbourhoods: the smallest neighbour of each node is an
aggregate that is reduced before the shuffle, and joining it back to the edges is
a sort-merge join whose hot partitions adaptive execution splits.  Each round is
written to the shared folder, so lineage stays short and lost executors cost one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm.common import drop_path, fresh_path


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _large(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on its smallest one, or on itself."""
    sides = _both(edges)
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return sides.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v")


def _small(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest; edges run from smaller u to larger v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    return edges.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").where(F.col("u") < F.col("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node it reaches.

    Null ends and loops are no edges; the order and repeats of edges don't matter.
    """
    spark = edges.sparkSession
    tidy = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    schema, before, path, old = tidy.schema, None, None, None
    for _ in range(most_rounds):
        old, path = path, fresh_path(spark, "stars")
        tidy.write.parquet(path)
        now = spark.read.schema(schema).parquet(path)
        if old:
            drop_path(spark, old)
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())
        if mark == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = mark
        tidy = _small(_large(now).distinct()).distinct()
    raise RuntimeError(f"no stable stars in {most_rounds} rounds")
