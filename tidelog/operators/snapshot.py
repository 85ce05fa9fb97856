"""Snapshots: merge of sources, visibility, latest version, liveness, overlay of uncommitted writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec as C
from ..model import POINTER, RESERVED_PREFIX


def merge(sources: list[DataFrame]) -> DataFrame:
    """Sources in order of precedence as one frame; of rows with the same key and version the earliest source's stays."""
    if not sources:
        raise ValueError("no sources")
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("_prio", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return first_wins(out, "_prio").drop("_prio")


def first_wins(df: DataFrame, *order) -> DataFrame:
    """One row for each (user_key, version), the first by ``order``."""
    w = Window.partitionBy("user_key", "version").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def concat(sources: list[DataFrame]) -> DataFrame:
    """Disjoint runs put together, nothing compared."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def latest(df: DataFrame, ts: int, *ties) -> DataFrame:
    """The newest version at or below ``ts`` of every key, dead ones included. Spark
    filters by rank before the shuffle as well as after it, so old versions stay on the map side."""
    w = Window.partitionBy("user_key").orderBy(F.desc("version"), *ties)
    return df.where(C.visible(ts)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def live(df: DataFrame, now_ms: int) -> DataFrame:
    return df.where(~C.dead(now_ms))


def without_internal(df: DataFrame, prefix: bytes = RESERVED_PREFIX) -> DataFrame:
    return df.where(~C.internal("user_key", prefix))


def as_of(df: DataFrame, ts: int, now_ms: int, *ties, internal_access: bool = False) -> DataFrame:
    """The store as a reader at ``ts`` sees it."""
    df = df if internal_access else without_internal(df)
    return live(latest(df, ts, *ties), now_ms)


def overlay(committed: DataFrame, pending: DataFrame, read_ts: int) -> DataFrame:
    """Committed rows up to ``read_ts`` and uncommitted ones, which stand at ``read_ts`` and come first there."""
    mine = pending.withColumn("version", F.lit(read_ts).cast("long")).withColumn("_prio", F.lit(-1))
    return committed.where(C.visible(read_ts)).withColumn("_prio", F.lit(0)).unionByName(mine)


def read_your_writes(committed: DataFrame, pending: DataFrame, read_ts: int, now_ms: int) -> DataFrame:
    return as_of(overlay(committed, pending, read_ts), read_ts, now_ms, "_prio").drop("_prio")


def max_version(df: DataFrame) -> DataFrame:
    return df.agg(F.max("version").alias("max_version"))


def resolve_values(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Values in place of pointers: rows with a ``value_ref`` take theirs from the blob table (file_id, user_key, version, payload)."""
    b = blobs.select(F.col("file_id").alias("_f"), F.col("user_key").alias("_k"), F.col("version").alias("_v"), "payload")
    j = rows.join(b, (F.col("value_ref.file_id") == F.col("_f")) & (F.col("user_key") == F.col("_k")) & (F.col("version") == F.col("_v")), "left")
    return j.withColumn("value", F.coalesce("value", "payload")).drop("_f", "_k", "_v", "payload", "value_ref")


def separate_values(rows: DataFrame, threshold: int, file_id: int) -> tuple[DataFrame, DataFrame]:
    """(rows with pointers in place of large values, the blob table)."""
    large = C.separated(threshold)
    ref = F.struct(F.lit(file_id).alias("file_id"), F.octet_length("value").alias("len"), F.lit(0).cast("long").alias("offset"))
    kept = rows.withColumn("value_ref", F.when(large, ref)).withColumn("meta", F.when(large, F.col("meta").bitwiseOR(POINTER)).otherwise(F.col("meta"))).withColumn("value", F.when(~F.coalesce(large, F.lit(False)), F.col("value")))
    return kept, rows.where(large).select(F.lit(file_id).alias("file_id"), "user_key", "version", F.col("value").alias("payload"))
