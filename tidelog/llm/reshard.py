"""Resharding by minimum-cost flow.

Old shards have sizes, new shards capacities. Moving a byte from shard i to j
costs ``cost(i, j)``, staying costs nothing. The network has one arc for each
pair, so its size depends on the number of shards alone; it is solved exactly
by successive cheapest paths. Documents are hashed into blocks inside their old
shard; only block sums come to the driver (shards x blocks rows, a parameter).
Blocks are then handed to the arcs, largest first, each arc up to its flow, and
only shards that lose or gain a block are rewritten.

Rows equal in doc_id, size and checksum are counted first and told apart by a
copy number, so that any number of copies spreads over blocks. Null text: size
1 (its end mark). Very long texts count by their bytes, and one larger than a
shard's share fills more than that share. Null doc_id: hashed like any other
value. Ties: equal costs take the shard of the smaller number, blocks of equal
bytes go in the order of old shard and number. More shards than documents: some
stay empty. Empty table: empty result. Columns other than those named are not
read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, free_shuffles

SHARDS, BLOCKS = 16, 2048


def min_cost_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], float]) -> dict[tuple[int, int], int]:
    """Units sent from each i to each j: all supply, at most the demand, at the least cost.

    Successive cheapest augmenting paths over the bipartite residual network
    (Bellman-Ford, since residual arcs have negative cost)."""
    left, room = list(supply), list(demand)
    n, m = len(left), len(room)
    flow = {(i, j): 0 for i in range(n) for j in range(m)}
    while True:
        dist: dict = {("s", i): 0.0 for i in range(n) if left[i] > 0}
        if not dist:
            return {k: v for k, v in flow.items() if v}
        came: dict = {}
        changed = True
        while changed:
            changed = False
            for i, j in flow:
                a, b, c = ("s", i), ("t", j), cost(i, j)
                if a in dist and dist[a] + c < dist.get(b, float("inf")) - 1e-12:
                    dist[b], came[b], changed = dist[a] + c, a, True
                if flow[i, j] and b in dist and dist[b] - c < dist.get(a, float("inf")) - 1e-12:
                    dist[a], came[a], changed = dist[b] - c, b, True
        ends = [("t", j) for j in range(m) if room[j] > 0 and ("t", j) in dist]
        if not ends:
            raise ValueError("the new shards cannot hold the data")
        end = min(ends, key=lambda x: (dist[x], x[1]))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[end[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "t":
                amount = min(amount, flow[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "s":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def transfers(sizes: dict[tuple[int, int], int], old_shards: int, room: list[int], cost=lambda i, j: 0.0 if i == j else 1.0) -> dict[tuple[int, int], int]:
    """New shard of every (old shard, block): the flow's arcs filled with whole
    blocks, largest first; a block that fits no arc goes where most is still due."""
    supply = [0] * old_shards
    for (i, _), n in sizes.items():
        supply[i] += n
    due = min_cost_flow(supply, room, cost)
    out = {}
    loose = []
    for (i, b), n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        arcs = sorted((j for (k, j), f in due.items() if k == i and f >= n), key=lambda j: (j != i, -due[i, j], j))
        if arcs:
            out[i, b] = arcs[0]
            due[i, arcs[0]] -= n
        else:
            loose.append((n, i, b))
    free = [sum(f for (_, k), f in due.items() if k == j) for j in range(len(room))]
    for n, i, b in loose:
        j = max(range(len(room)), key=lambda j: (free[j], -j))
        out[i, b] = j
        free[j] -= n
    return out


def by_source(source: str = "source", shards: int = SHARDS) -> Column:
    """The layout that is resharded: one shard for a source's files, several sources to a shard."""
    return F.pmod(F.crc32(F.coalesce(F.col(source), F.lit("\x00"))), F.lit(shards)).cast("int")


def assign(docs: DataFrame, old_shard: Column, shards: int = SHARDS, blocks: int = BLOCKS, old_shards: int = SHARDS, cost=lambda i, j: 0.0 if i == j else 1.0) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot (gapless from 0 in its shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old_shard.alias("old_shard"))
    same = rows.groupBy("doc_id", "size", "text_crc32", "old_shard").agg(F.count(F.lit(1)).alias("n"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    each = cut(each.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(blocks)).cast("int")))
    sums = each.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    sizes = {(r["old_shard"], r["block"]): r["bytes"] for r in sums}
    new = transfers(sizes, old_shards, capacities(sum(sizes.values()), shards), cost)
    fill = [0] * shards
    plan = []
    for r in sorted(sums, key=lambda r: (r["old_shard"], r["block"])):
        j = new[r["old_shard"], r["block"]]
        plan.append((r["old_shard"], r["block"], j, fill[j]))
        fill[j] += r["rows"]
    plan_df = F.broadcast(spark.createDataFrame(plan, "old_shard int, block int, shard int, first long"))  # shards x blocks rows at most
    at = Window.partitionBy("old_shard", "block").orderBy("doc_id", "size", "text_crc32", "copy")
    return each.join(plan_df, ["old_shard", "block"]).withColumn("slot", F.col("first") + F.row_number().over(at) - 1).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


#: Off, a join takes sides that are dealt by a part of its keys as they are.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _rows_at(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """A table of :func:`cut`: row (all columns of ``docs``), shard and slot of every row that has a place in ``placed``."""
    text = F.coalesce("text", F.lit(""))

    def keys(size, crc):
        return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), size.alias("bytes"), crc.alias("crc")]

    # equal rows are interchangeable: the k-th of them takes the k-th place
    by = ["id", "none", "bytes", "crc"]
    a = docs.select(F.struct("*").alias("row"), *keys((F.octet_length(text) + 1).cast("long"), F.crc32(text)))
    a = a.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("id")))
    b = placed.select(*keys(F.col("size"), F.col("text_crc32")), "shard", "slot")
    b = b.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("shard", "slot")))
    conf = docs.sparkSession.conf
    before = conf.get(_ALL_KEYS, "true")
    conf.set(_ALL_KEYS, "false")  # the windows have dealt both sides by their first four keys, so rows travel once
    try:
        return cut(a.join(b.hint("merge"), [*by, "k"]).select("row", "shard", "slot"))
    finally:
        conf.set(_ALL_KEYS, before)


def resharded(docs: DataFrame, old_shard: Column, **sizes) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, with their shard and slot, in slot order within a shard."""
    placed = cut(assign(docs, old_shard, **sizes))
    found = _rows_at(docs, placed)
    drop_cut(placed)
    free_shuffles(docs.sparkSession)
    out = found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    return out.select("row.*", "shard", "slot")


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the shards that lose or gain a document under ``path`` (a folder ``_shard=k`` a
    shard, documents in slot order) and return their numbers; all others keep their files.

    A shard's folder is replaced as a whole, so a second run after a failure gives the same
    folders. ``docs`` must not be read from ``path``."""
    spark = docs.sparkSession
    moved = placed.where("shard <> old_shard")
    touched = sorted({x for r in moved.groupBy("old_shard", "shard").count().collect() for x in (r["old_shard"], r["shard"])})
    filled = {r["shard"] for r in placed.select("shard").distinct().collect()}
    found = _rows_at(docs, placed.where(F.col("shard").isin(touched)))
    out = found.withColumnRenamed("shard", "_shard").repartitionByRange("_shard", "slot").sortWithinPartitions("_shard", "slot")
    out.select("row.*", "_shard").write.partitionBy("_shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    drop_cut(found)
    for k in set(touched) - filled:  # a shard that has lost all it had
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_shard={k}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return touched
