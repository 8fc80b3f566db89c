"""The operators as queries over a folder of tables, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcwell.llm import bpe, chat, line_dedup, mpeg_audio, packing, quality, rules, sharding, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores if they lie in fewer parts than that, as one small file does."""
    docs = _table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.select("doc_id", "text", "lang").repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digests(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return substrings.dedup_substrings(docs).select("doc_id", "kept_text", "spans", "n_lost_words")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_probe(_table(spark, sf_dir, "conversations")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_mpeg_audio, op3_best_fit_packing, op4_bpe, op5_substring_dedup, op6_simhash, op7_chat_formatting, op8_quality_rules, op9_sharding, op10_line_dedup)}

ORACLE_SQL: dict[str, str] = {"op10_line_dedup": line_dedup.SQL}
