"""Analytics over the whole history of a store; the entry log itself does not need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec as C
from ..model import DELETE


def history(df: DataFrame) -> DataFrame:
    """Every version with the value and version before it."""
    w = Window.partitionBy("user_key").orderBy("version")
    return df.withColumn("old_value", F.lag("value").over(w)).withColumn("old_version", F.lag("version").over(w))


def asof_join(facts: DataFrame, dim: DataFrame, key: str, ts: str, now_ms: int) -> DataFrame:
    """Facts with the dimension's value as it was at ``ts``: both are put in one frame and the last
    version before a fact is carried forward, so neither side is multiplied. Dead versions give null."""
    cell = F.struct("value", "version", C.dead(now_ms).alias("dead"))
    a = dim.select(F.col("user_key").alias("_k"), F.col("version").alias("_t"), F.lit(0).alias("_side"), cell.alias("_cell"), F.lit(None).cast(facts.select(F.struct("*").alias("f")).schema["f"].dataType).alias("_fact"))
    b = facts.select(F.col(key).alias("_k"), F.col(ts).cast("long").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_cell"].dataType).alias("_cell"), F.struct("*").alias("_fact"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = a.unionByName(b).withColumn("_last", F.last("_cell", ignorenulls=True).over(w)).where("_side = 1")
    live = ~F.coalesce(F.col("_last.dead"), F.lit(True))
    return j.select("_fact.*", F.when(live, F.col("_last.value")).alias("value"), F.when(live, F.col("_last.version")).alias("version"))


def garbage(df: DataFrame, now_ms: int) -> DataFrame:
    """Rows by what a full compaction would do: live newest versions, dead newest ones, older ones. Rows are unique in (user_key, version)."""
    deleted = F.col("meta").bitwiseAND(DELETE) != 0
    slim = df.select("user_key", "version", C.dead(now_ms).alias("dead"), deleted.alias("deleted"), F.octet_length("value").cast("long").alias("size"))
    # a key's rows shrink to its newest one and sums before the shuffle, so a hot key is one row of each task
    one = slim.groupBy("user_key").agg(F.max(F.struct("version", "dead", "deleted", "size")).alias("top"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count(F.when(F.col("deleted"), 1)).alias("deletes"))
    top = F.struct(F.when(F.col("top.dead"), "dead").otherwise("live").alias("state"), F.lit(1).cast("long").alias("n"), F.col("top.size").alias("bytes"), F.col("top.deleted").cast("long").alias("deletes"))
    old = F.struct(F.lit("old").alias("state"), (F.col("n") - 1).alias("n"), (F.col("bytes") - F.col("top.size")).alias("bytes"), (F.col("deletes") - F.col("top.deleted").cast("long")).alias("deletes"))
    return one.select(F.inline(F.array(top, old))).where("n > 0").groupBy("state").agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("bytes"), F.sum("deletes").alias("deletes"))
