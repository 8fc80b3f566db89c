"""Sharding by rendezvous hashing over weighted shards.

Every shard scores every key, -weight / ln(u) with u from a hash of key and
shard, and the highest score takes it.  A score depends on nothing but the key and
its shard, so a further shard wins rows only for itself and moves no others; the
share of a shard is its weight over the sum.  Keys are the stable record ids.

All of it is DataFrame expressions.  Texts are read once and never shuffled: ids,
sizes, checksums and shards are written to the shared folder and read from there
to be counted and numbered.  Slots are numbered in two steps: rows are counted by
shard and one of `runs` sub-ranges of a hash, a running sum of those few counts
gives each sub-range its first slot, and row numbers within a sub-range add to it.
So no task sorts a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwell.llm.common import kept


def score(key: Column, shard: Column, weight: float | Column = 1.0) -> Column:
    """-weight / ln(u), u in (0, 1) from the upper 52 bits of a hash of key and shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.lit(weight) / F.log(u) if not isinstance(weight, Column) else -weight / F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct(score, shard) of the winning shard; ties go to the greater number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    each = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_max(F.transform(each, lambda w, i: F.struct(score(key, i, w).alias("score"), i.alias("shard"))))


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """docs with their shard; with grown, also grown_shard under these further weights behind the first ones.

    Null keys share one hash and so one shard; repeated keys meet in one shard.  A
    column of docs that has the name of an added one is replaced.
    """
    won = rendezvous(F.col(key), weights)
    out = docs.withColumn("__aw_won", won).withColumn(shard, F.col("__aw_won.shard").cast("int"))
    if grown is not None:
        more = F.array(*[F.lit(float(w)) for w in grown])
        best = F.array_max(F.concat(F.array(F.col("__aw_won")), F.transform(more, lambda w, i: F.struct(score(F.col(key), i + len(weights), w).alias("score"), (i + len(weights)).alias("shard")))))
        out = out.withColumn("grown_shard", best["shard"].cast("int"))
    return out.drop("__aw_won")


def slots(rows: DataFrame, order: list[str], shard: str = "shard", runs: int = 512) -> DataFrame:
    """rows with slot, gapless from 0 within each shard, in the order of a hash of the `order` columns."""
    run = F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int")
    rows = rows.withColumn("__aw_run", run)
    counts = rows.groupBy(shard, "__aw_run").agg(F.count("*").alias("__aw_n"))
    before = Window.partitionBy(shard).orderBy("__aw_run").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("__aw_shard"), F.col("__aw_run").alias("__aw_of"), F.coalesce(F.sum("__aw_n").over(before), F.lit(0)).alias("__aw_first"))
    within = Window.partitionBy(shard, "__aw_run").orderBy(*order)
    # runs x shards rows at most, whatever the input: proven small enough to broadcast
    out = rows.withColumn("__aw_k", F.row_number().over(within)).join(F.broadcast(first), (F.col(shard) == F.col("__aw_shard")) & (F.col("__aw_run") == F.col("__aw_of")))
    return out.withColumn("slot", (F.col("__aw_first") + F.col("__aw_k") - 1).cast("long")).drop("__aw_run", "__aw_k", "__aw_shard", "__aw_of", "__aw_first")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; a null text has no bytes and the checksum of none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # counted and numbered: texts are read for the first of these only
    placed = kept(assign(rows, [1.0] * shards, [1.0]).withColumn("law", F.lit("key")), "placed")
    return slots(placed, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
