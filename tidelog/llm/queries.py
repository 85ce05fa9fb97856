"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton_dedup, bagminhash, chat_tools, decontam, mixing, quality, reshard, secret_scan, suffix_dedup, toxicity
from .common import table
from .sql import ORACLES


def op1_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat_tools.link(chat_tools.as_tool_traffic(table(spark, sf_dir, "conversations")), chat_tools.REPLY)
    return linked.withColumn("errors", F.concat_ws("; ", "errors"))


def op2_randomness_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which of several rules rejected a text depends on their measured order, so it is no part of the result
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard.assign(table(spark, sf_dir, "documents"), reshard.by_source())
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op5_histogram_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_tool_links,
    op2_randomness_tests,
    op3_quality_cascade,
    op4_flow_reshard,
    op5_histogram_mix,
    op6_spaced_seeds,
    op7_suffix_array,
    op8_bagminhash,
    op9_suffix_automata,
    op10_kneser_ney,
)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLES", "QUERIES"]
