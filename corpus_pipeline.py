"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage reads what the one before has written and returns the columns of its
input, whatever their names; the last one adds ``shard`` and ``slot``. Null and
empty texts go in the first stage, which wants 50 words; a stage that is called
by itself takes them as empty texts. Very long texts are judged whole. Ties: of
near duplicates the row with the smallest doc_id stays, of rows with that id the
one with the smallest text digest; rows equal in doc_id are mixed together.
Repeated rows: one stays in the second stage. Null doc_id: like any other, last
among equals. Null source: a source of its own. An empty table, or one of which
nothing is left, gives an empty result with the same columns. A name of the
input that is also ``shard`` or ``slot`` stands twice after the last stage, so
rename it before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bagminhash, decontam, mixing, quality, reshard
from tidelog.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that a quality rule rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return bagminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a passage of a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, whole, with its place after resharding from one shard a source to equal bytes."""
    return reshard.resharded(docs, reshard.by_source())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: MinHash classes and the flow's block transfers have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
