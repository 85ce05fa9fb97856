"""Mixing sources to target weights with nested hash-threshold histograms.

DataFrame functions only. Every document has a 52-bit hash. A source's words
are summed by the leading 13 bits; the bucket in which the running sum passes
the budget is the boundary, and only its documents are summed again by the next
13 bits, and so on. After four levels the boundary is one hash value. Documents
with a smaller hash are taken once more, all others are not: nothing is sorted
but at most 8192 sums of a source at a level.

A target above a source's size takes every document once and a part of them
twice. The boundary value itself is taken where that brings the sum nearer.

Null text: size 0. Null doc_id: hashed as an empty text, with the document's
text. Null source: a source of its own, last. Very long texts count whole, and
the one on a boundary is taken where that comes nearer. Ties: rows equal in
doc_id (of null ids: in text) share a hash, and are taken or left together. Sources without words get target
0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
DIGITS, LEVELS = 13, 4


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: starts of words, found without making the words."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.regexp_count(flat, F.lit("[^ ]+")).cast("long")


def hash52() -> Column:
    name = F.concat_ws("\x1f", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    whole = F.when(F.col("doc_id").isNull(), F.concat_ws("\x1f", name, F.md5(F.coalesce("text", F.lit(""))))).otherwise(name)
    return F.conv(F.substring(F.md5(whole), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the 52-bit hash ``h`` of every row."""
    return docs.select("doc_id", "source", word_count().alias("size"), hash52().alias("h"))


def targets(by_source: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size and target, from source and source_size.

    Sources in code-point order, null last, take the weights in turn. The cap
    and the resharing of what lies above it have one fixed point: with sources
    in order of size by weight, those up to some place are capped and the rest
    share what is left by weight.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = by_source.withColumn("place", F.row_number().over(place) - 1)
    turn = F.pmod("place", F.lit(len(weights)))
    w = w.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    w = w.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.lit(float(budget)) * F.sum("source_size").over(everything)
    w = w.withColumn("rate", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    free = F.col("cap") >= F.col("rate") * F.col("w")
    w = w.withColumn("rate", F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), F.col("place"), F.col("rate"))).otherwise(None)).over(everything).getField("rate"))
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("rate") * F.col("w"), F.col("cap"))).alias("target"))


#: Up to so many sources the table of thresholds (some 60 bytes a source) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def thresholds(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target, times and limit of every source, from the rows of :func:`sized`.

    A document is taken ``times`` times, and once more if its hash is under ``limit``."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(by_source, weights, budget, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("times", times)
    # lo: the hash interval that still holds the boundary begins here; rest: words still to take from it
    state = cut(goal.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("lo", F.lit(0).cast("long")))
    for level in range(LEVELS):
        shift = DIGITS * (LEVELS - 1 - level)
        inside = rows
        if level:
            held = state.select(F.col("source").alias("s"), "lo")
            inside = rows.join(held, rows["source"].eqNullSafe(held["s"]) & (F.shiftright("h", shift + DIGITS) == F.shiftright("lo", shift + DIGITS))).select(*rows.columns)
        sums = inside.groupBy("source", F.shiftleft(F.shiftright("h", shift), shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("sum_before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        at = state.alias("g").join(sums.alias("b"), F.col("g.source").eqNullSafe(F.col("b.source")) & (F.col("b.sum_before") <= F.col("g.rest")))
        edge = at.groupBy("g.source").agg(F.max(F.struct("b.bucket", "b.sum_before", "b.n")).alias("e"))
        kept = state.alias("g").join(edge.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
        keep = ["source", "source_size", "target", "times"]
        new = cut(kept.select(*(F.col(f"g.{c}").alias(c) for c in keep), (F.col("g.rest") - F.coalesce("e.sum_before", F.lit(0))).alias("rest"), F.coalesce("e.bucket", "g.lo").alias("lo"), F.coalesce("e.n", F.lit(0)).alias("n")))
        drop_cut(state)
        state = new
    # what is left of the budget against the boundary value's own words; whoever has all ``most`` copies takes no more
    limit = F.when(F.col("times") >= most, F.lit(0)).when(2 * F.col("rest") > F.col("n"), F.col("lo") + 1).otherwise(F.col("lo"))
    return state.select("source", "source_size", "target", "times", limit.cast("long").alias("limit"))


def _copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with source and h) and how often each is taken, as ``copies``."""
    side = found.withColumnRenamed("source", "_s")
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, rows["source"].eqNullSafe(side["_s"])).withColumn("copies", F.col("times") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (times 0 to ``most`` the size) of every row."""
    rows = cut(sized(docs))
    taken = _copies(rows, thresholds(rows, weights, budget, most))
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; documents without words are not taken."""
    rows = cut(sized(docs))
    # the row travels as one struct, so its columns cannot clash with those of the join
    whole = docs.select(F.struct("*").alias("row"), "source", hash52().alias("h"), word_count().alias("size"))
    found = thresholds(rows, weights, budget, most)
    drop_cut(rows)
    taken = _copies(whole, found).where("size > 0 AND copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


#: The same mix by one sort of all documents; only small tables afford it.
MIX_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix' || chr(31) || coalesce(doc_id::VARCHAR, '') || CASE WHEN doc_id IS NULL THEN chr(31) || md5(coalesce(text, '')) ELSE '' END), 1, 13))::BIGINT AS h
  FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(rate, (cap / w, place)) FROM r WHERE cap >= rate * w) * w, cap)) AS target FROM r),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM g),
v AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT v.source, v.h, v.n, t.target - t.times * t.source_size AS rest,
    coalesce(sum(v.n) OVER (PARTITION BY v.source ORDER BY v.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source),
e AS (SELECT source, max(h) AS h, arg_max(n, h) AS n, arg_max(rest - bef, h) AS rest FROM c WHERE bef <= rest GROUP BY source)
SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  (d.size * (t.times + CASE WHEN t.times < 2 AND (d.h < e.h OR d.h = e.h AND 2 * e.rest > e.n) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source
"""
