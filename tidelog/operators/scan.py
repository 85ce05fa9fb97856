"""Ordered scans, seeks and neighbours over any frame of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec as C
from .snapshot import as_of, without_internal


def ordered(df: DataFrame, reverse: bool = False) -> DataFrame:
    """Keys ascending and versions descending, or the mirror image."""
    return df.orderBy(F.desc("user_key"), "version") if reverse else df.orderBy("user_key", F.desc("version"))


def scan(df: DataFrame, ts: int, now_ms: int, reverse: bool = False, prefix: bytes | None = None, internal_access: bool = False) -> DataFrame:
    if prefix is not None:
        df = df.where(C.has_prefix("user_key", prefix))
    return ordered(as_of(df, ts, now_ms, internal_access=internal_access), reverse)


def all_versions(df: DataFrame, ts: int, reverse: bool = False, internal_access: bool = False) -> DataFrame:
    """Every version up to ``ts``, dead ones too."""
    df = df if internal_access else without_internal(df)
    return ordered(df.where(C.visible(ts)), reverse)


def seek(df: DataFrame, key: bytes, ts: int, now_ms: int, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """The snapshot from ``key`` on, in either direction; an empty key is the first or last."""
    if key:
        df = df.where(F.col("user_key") <= C.lit_bytes(key) if reverse else F.col("user_key") >= C.lit_bytes(key))
    out = scan(df, ts, now_ms, reverse)
    return out if limit is None else out.limit(limit)


def prefix_scan(df: DataFrame, prefix: bytes, ts: int, now_ms: int, reverse: bool = False) -> DataFrame:
    return scan(df, ts, now_ms, reverse, prefix)


def first_last(df: DataFrame) -> DataFrame:
    return df.agg(F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"))


def point_get(df: DataFrame, key: bytes, ts: int, now_ms: int) -> DataFrame:
    """No row if the key's newest visible version is dead."""
    return raw_get(df, key, ts).where(~C.dead(now_ms))


def raw_get(df: DataFrame, key: bytes, ts: int) -> DataFrame:
    """The newest version up to ``ts``, dead or not."""
    return df.where((F.col("user_key") == C.lit_bytes(key)) & C.visible(ts)).orderBy(F.desc("version")).limit(1)


def get_many(df: DataFrame, keys: DataFrame, ts: int, now_ms: int) -> DataFrame:
    """Point reads of a table of keys (user_key) in one job."""
    return as_of(df.join(keys.select("user_key").distinct(), "user_key", "left_semi"), ts, now_ms, internal_access=True)


#: Direction and bound of the four neighbour searches.
NEAREST = {"gt": (">", F.min), "ge": (">=", F.min), "lt": ("<", F.max), "le": ("<=", F.max)}


def nearest(df: DataFrame, probes: list[bytes], kind: str) -> DataFrame:
    """For each probe the nearest key on one side, null if there is none: a scan of the keys for each of a few probes."""
    op, pick = NEAREST[kind]
    k = F.col("user_key")
    test = {">": k.__gt__, ">=": k.__ge__, "<": k.__lt__, "<=": k.__le__}[op]
    aggs = [pick(F.when(test(C.lit_bytes(p)), k)).alias(f"p{i}") for i, p in enumerate(probes)]
    wide = df.agg(*aggs)
    pairs = F.array(*(F.struct(C.lit_bytes(p).alias("probe"), F.col(f"p{i}").alias("found")) for i, p in enumerate(probes)))
    return wide.select(F.inline(pairs))


def search(df: DataFrame, column: str, predicate) -> DataFrame:
    """The least value of ``column`` for which a monotone predicate holds."""
    return df.where(predicate).agg(F.min(column).alias(column))


def key_splits(df: DataFrame, block_rows: int, n: int, prefix: bytes = b"", file: str = "file_id") -> DataFrame:
    """Keys that cut each file's blocks (of ``block_rows`` rows) into about ``n`` ranges, those with the prefix."""
    if n == 0:
        return df.sparkSession.createDataFrame([], "file_id long, user_key binary")
    w = Window.partitionBy(file).orderBy("user_key", F.desc("version"))
    rows = df.select(file, "user_key", F.row_number().over(w).alias("_rn"), F.count(F.lit(1)).over(Window.partitionBy(file)).alias("_rows"))
    blocks = F.ceil(F.col("_rows") / block_rows)
    jump = F.greatest(F.floor(blocks / n), F.lit(1))
    block = (F.col("_rn") - 1) / block_rows
    at_start = F.pmod(F.col("_rn") - 1, F.lit(block_rows)) == 0
    return rows.where(at_start & (F.pmod(block.cast("long"), jump) == 0) & C.has_prefix("user_key", prefix)).select(file, "user_key")
