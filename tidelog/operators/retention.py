"""Retention: which versions a compaction keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec as C
from ..model import DISCARD_EARLIER, KEEP_ALL, MERGE_ENTRY


def retain(df: DataFrame, discard_ts: int, keep: int, now_ms: int, has_overlap: bool) -> DataFrame:
    """Rows that survive, from rows unique in (user_key, version).

    Versions above ``discard_ts`` and merge entries are kept and not counted.
    Of the others, newest first, the first that is dead, or discards what is
    earlier, or is the ``keep``-th, is the last one looked at. A dead one stays
    only where older data may lie elsewhere (``has_overlap``). One shuffle and
    one sort serve both running values.
    """
    w = Window.partitionBy("user_key").orderBy(F.desc("version"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = C.visible(discard_ts) & (F.col("meta").bitwiseAND(MERGE_ENTRY) == 0)
    gone = C.dead(now_ms)
    df = df.withColumn("_counted", counted).withColumn("_dead", gone)
    n = F.sum(F.col("_counted").cast("int")).over(upto)
    last = F.col("_counted") & (F.col("_dead") | (F.col("meta").bitwiseAND(DISCARD_EARLIER) != 0) | (n == keep))
    df = df.withColumn("_last", last)
    df = df.withColumn("_past", F.coalesce(F.max(F.col("_last").cast("int")).over(before), F.lit(0)))
    out = df.where("_past = 0")
    if not has_overlap:
        out = out.where("NOT (_counted AND _dead)")
    return out.drop("_counted", "_dead", "_last", "_past")


def retain_hot(df: DataFrame, discard_ts: int, keep: int, now_ms: int, has_overlap: bool) -> DataFrame:
    """The same rows as :func:`retain` where a few keys hold much of the data.

    A key's last version looked at is the greatest that is dead or discards what
    is earlier, or its ``keep``-th counted one, whichever is greater. Both come
    from aggregations that shrink on the map side, without values; the rows then
    meet their key's bound in a join, whose hot partitions Spark splits. So no
    task holds all versions of a key, which a window would need."""
    counted = C.visible(discard_ts) & (F.col("meta").bitwiseAND(MERGE_ENTRY) == 0)
    gone = C.dead(now_ms)
    slim = df.where(counted).select("user_key", "version", (gone | (F.col("meta").bitwiseAND(DISCARD_EARLIER) != 0)).alias("ends"))
    bounds = slim.where("ends").groupBy("user_key").agg(F.max("version").alias("bound"))
    if keep == 1:
        bounds = slim.groupBy("user_key").agg(F.max("version").alias("bound"))
    elif keep < KEEP_ALL:
        w = Window.partitionBy("user_key").orderBy(F.desc("version"))
        nth = slim.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).groupBy("user_key").agg(F.max(F.when(F.col("_rn") == keep, F.col("version"))).alias("bound"))
        bounds = bounds.unionByName(nth).groupBy("user_key").agg(F.max("bound").alias("bound"))
    out = df.join(bounds, "user_key", "left").where(F.col("bound").isNull() | (F.col("version") >= F.col("bound"))).drop("bound")
    return out if has_overlap else out.where(~(counted & gone))


def merged(df: DataFrame, parts: int, discard_ts: int, keep: int, now_ms: int, has_overlap: bool, hot: list[bytes] = ()) -> DataFrame:
    """What a compaction keeps of rows with ``seq`` that may hold a key and version several times (the newest
    source counts), dealt by key ranges and in file order: key ascending, version descending.

    One exchange and one sort serve the merge, the retention and the files. Rows of
    ``hot`` keys, each too many for one task, go by ranges of key and version
    instead, and meet their bounds in a join (:func:`retain_hot`)."""
    many = F.col("user_key").isin([F.lit(bytearray(k)) for k in hot]) if hot else F.lit(False)
    w = Window.partitionBy("user_key").orderBy(F.desc("version"), F.desc("seq"))
    cold = (df.where(~many) if hot else df).repartitionByRange(parts, "user_key").sortWithinPartitions("user_key", F.desc("version"), F.desc("seq"))
    cold = cold.withColumn("_above", F.lag("version").over(w)).where("_above IS NULL OR _above <> version").drop("_above")
    out = retain(cold, discard_ts, keep, now_ms, has_overlap)
    if not hot:
        return out
    rows = df.where(many).repartitionByRange(parts, "user_key", F.desc("version"))
    two = Window.partitionBy("user_key", "version").orderBy(F.desc("seq"))
    rows = rows.withColumn("_rn", F.row_number().over(two)).where("_rn = 1").drop("_rn")
    rows = retain_hot(rows, discard_ts, keep, now_ms, has_overlap)
    return out.unionByName(rows.sortWithinPartitions("user_key", F.desc("version")))


def latest_versions(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_key").orderBy(F.desc("version"))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def discard_earlier(df: DataFrame, discard_ts: int, now_ms: int) -> DataFrame:
    return retain(df, discard_ts, KEEP_ALL, now_ms, True)


def drop_prefixes(df: DataFrame, prefixes: list[bytes]) -> DataFrame:
    return df.where(~C.has_any_prefix("user_key", prefixes))
