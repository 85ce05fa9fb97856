"""Key ranges: their algebra on the driver, and overlap as a join."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch


@dataclass(frozen=True)
class KeyRange:
    """[left, right], everything (infinite), or nothing (no bounds)."""

    left: bytes | None = None
    right: bytes | None = None
    infinite: bool = False

    @property
    def is_empty(self) -> bool:
        return not self.infinite and self.left is None

    def extend(self, other: KeyRange) -> KeyRange:
        """The smallest range over both."""
        if other.is_empty:
            return self
        if self.is_empty:
            return other
        if self.infinite or other.infinite:
            return INFINITE
        return KeyRange(min(self.left, other.left), max(self.right, other.right))

    def overlaps(self, other: KeyRange) -> bool:
        """Not symmetric: nothing overlaps everything asked of it, but an empty range asked about overlaps only nothing."""
        if self.is_empty:
            return True
        if other.is_empty:
            return False
        if self.infinite or other.infinite:
            return True
        return other.right >= self.left and self.right >= other.left


EMPTY, INFINITE = KeyRange(), KeyRange(infinite=True)


def hull(ranges: list[KeyRange]) -> KeyRange:
    out = EMPTY
    for r in ranges:
        out = out.extend(r)
    return out


def file_key_ranges(df: DataFrame, file: str = "file_id") -> DataFrame:
    """Smallest and biggest key, versions and rows of each file: one partial aggregation."""
    return df.groupBy(file).agg(F.min("user_key").alias("smallest"), F.max("user_key").alias("biggest"), F.min("version").alias("min_version"), F.max("version").alias("max_version"), F.count(F.lit(1)).alias("n_rows"))


#: Keys that the key space is cut at for :func:`overlapping`, at most.
CUTS = 256
#: Files that begin in one stretch and are held against others by one task, and pairs that a partition tries.
BLOCK, PAIRS = 512, 1_000_000


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of files whose ranges meet, under the names ``a`` and ``b``; both sides are file lists (smallest, biggest), a row for a file.

    The lists are written down first, so what they are made from is read once. The
    key space is cut at up to ``CUTS`` of the smallest keys. Two ranges that meet do
    so in the stretch where the later one of them begins: a row stands for its file
    where that begins, and one for each stretch that the other reaches into. So each
    pair is tried once at most, and only if both reach the same stretch. Files that
    begin in one stretch are dealt over blocks, and the others go to every block."""
    same = a is b
    a = _written(a)
    b = a if same else _written(b)
    picked = a.select("smallest").union(b.select("smallest")).where("smallest IS NOT NULL").distinct().orderBy(F.xxhash64("smallest"), "smallest").limit(CUTS)
    cuts = sorted(bytes(r[0]) for r in picked.collect())
    at = F.array(*(F.lit(bytearray(c)) for c in cuts)) if cuts else F.array().cast("array<binary>")

    def stretch(key):
        """How many cuts lie at or below a key."""
        return F.size(F.filter(at, lambda c: c <= F.col(key)))

    def placed(df, name):
        row = F.struct(*(F.col(c) for c in df.columns)).alias(name)
        return df.where("smallest <= biggest").select(row, stretch("smallest").alias("_from"), stretch("biggest").alias("_to"))

    def spans(df):
        return [tuple(r) for r in df.groupBy("_from", "_to").count().collect()]

    x, y = placed(a, "a"), placed(b, "b")
    of_x = spans(x)
    of_y = of_x if same else spans(y)

    def later(begin, of_begin, reach, of_reach, gap):
        """Pairs of a file of ``begin`` and one of ``reach`` that began in an earlier stretch or, without ``gap``, in the same one."""
        starts, open_ = [0] * (len(cuts) + 1), [0] * (len(cuts) + 2)
        for k, _, n in of_begin:
            starts[k] += n
        for k, end, n in of_reach:
            if k + gap <= end:
                open_[k + gap] += n
                open_[end + 1] -= n
        tries = sum(n * m for n, m in zip(starts, accumulate(open_)))
        blocks = F.element_at(F.array(*(F.lit(-(-n // BLOCK)) for n in starts)), F.col("_at") + 1)
        here = begin.withColumn("_at", F.col("_from")).withColumn("_block", F.pmod(F.xxhash64(begin.columns[0]), blocks).cast("int")).drop("_from", "_to")
        there = reach.where(F.col("_from") + gap <= F.col("_to")).withColumn("_at", F.explode(F.sequence(F.col("_from") + gap, "_to"))).drop("_from", "_to")
        there = there.withColumn("_n", blocks).where("_n > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        parts = max(1, -(-tries // PAIRS))
        here, there = (d.repartition(parts, "_at", "_block") for d in (here, there))
        return here.join(there.hint("merge"), ["_at", "_block"]).select("a", "b")

    meet = (F.col("a.smallest") <= F.col("b.biggest")) & (F.col("b.smallest") <= F.col("a.biggest"))
    return later(y, of_y, x, of_x, 0).union(later(x, of_x, y, of_y, 1)).where(meet)


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overlapping_files(files: DataFrame, left: bytes, right: bytes) -> DataFrame:
    """Files that a range touches."""
    return files.where((F.col("biggest") >= F.lit(bytearray(left))) & (F.col("smallest") <= F.lit(bytearray(right))))


def any_overlap(files: DataFrame, top: DataFrame) -> DataFrame:
    """One row, ``overlap``: whether the range over all ``top`` files touches one of ``files``."""
    r = top.agg(F.min("smallest").alias("lo"), F.max("biggest").alias("hi"))
    hit = files.join(F.broadcast(r), (F.col("biggest") >= F.col("lo")) & (F.col("smallest") <= F.col("hi")), "left_semi")
    return hit.agg((F.count(F.lit(1)) > 0).alias("overlap"))
