"""The driver's tables as versioned entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_MS = 604_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entry(key: Column, version: Column, meta: Column, user_meta: Column, expires_at: Column, value: Column, *more: Column) -> list[Column]:
    return [
        F.encode(key, "UTF-8").alias("user_key"),
        version.cast("long").alias("version"),
        meta.cast("int").alias("meta"),
        user_meta.cast("int").alias("user_meta"),
        expires_at.cast("long").alias("expires_at"),
        F.encode(value, "UTF-8").alias("value"),
        *more,
    ]


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events: errors delete, signups discard what is earlier, views live for a week."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(
        *_entry(
            F.format_string("u%06d", "user_id"),
            F.col("event_id") + 1,
            F.when(kind == "error", 1).when(kind == "signup", 4).otherwise(0),
            F.col("event_id") % 256,
            F.when(kind == "view", ms + WEEK_MS).otherwise(0),
            F.col("props"),
        )
    )


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(*_entry(F.format_string("c%08d", "o_custkey"), F.col("o_orderkey") + 1, F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.lit(0), F.lit(0), F.col("o_orderpriority")))


#: Order of precedence among lineitem rows of one key and version.
LINE_PRIORITY = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def kv_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, with several rows for some keys and versions."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*_entry(F.format_string("o%010d", "l_orderkey"), F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.lit(0), F.lit(0), F.col("l_linestatus"), *(F.col(c) for c in LINE_PRIORITY)))


def kv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, many of them large enough to be stored apart."""
    d = table(spark, sf_dir, "documents")
    return d.select(*_entry(F.format_string("d%08d", "doc_id"), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.coalesce("text", F.lit(""))))
