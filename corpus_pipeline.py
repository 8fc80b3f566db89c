"""A corpus in five stages: each works on all that the one before kept.

Null texts count as empty, and come back as empty ones from the stages that change
texts.  Documents without a doc_id keep their lines and passages and stay.  Rows
with one doc_id are one document.  Further columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm import line_dedup, near_copies, packing, quality, substrings
from arcwell.llm.common import drop_path, fresh_path, kept, scope
from arcwell.shipping import ship


def _plain(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under names that clash with none of an operator's."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"column{k}") for k, c in enumerate(docs.columns)])


def _named(docs: DataFrame, out: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs from what an operator made of _plain(docs); a text that it changed also sets n_chars."""

    def column(k: int, c: str):
        if c == "text":
            return F.col(text)
        if c == "n_chars" and text != "text":
            return F.char_length(text).cast(docs.schema[c].dataType)
        return F.col(c if c == "doc_id" else f"column{k}")

    return out.select(*[column(k, c).alias(c) for k, c in enumerate(docs.columns)])


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like any other, repeated rows stay or go together."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return _named(docs, quality.score(_plain(docs), model).where(F.col("score") >= 0.3))


def without_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them."""
    ship(spark)
    return _named(docs, line_dedup.dedup_lines(_plain(docs)), "kept_text")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: operator 6's index finds candidates, five-word Jaccard similarities of 0.8 or more link them."""
    ship(spark)
    return _named(docs, near_copies.one_of_each(_plain(docs)))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that several documents hold stay in the first of them."""
    ship(spark)
    return _named(docs, substrings.dedup_substrings(_plain(docs)), "kept_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: PIECES with sequence_id and offset, as op3 returns them."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", classified), ("lines", without_lines), ("near copies", without_copies), ("passages", without_passages), ("packing", packed)]

#: No stage but the second has SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; what each keeps is written and read again.

    One table is left in the shared folder, the result's, until the application ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        at = fresh_path(spark, "stage")
        with scope(spark):
            docs = kept(stage(spark, docs, sf_dir), path=at)
        if before:
            drop_path(spark, before)
        before = at
    return docs
