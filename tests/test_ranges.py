"""Overlap of file lists: every pair once, with work that follows the pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidelog.operators import ranges

SHAPE = "file_id long, smallest binary, biggest binary"


def files(spark, rows):
    return spark.createDataFrame([(k, lo and bytearray(lo), hi and bytearray(hi)) for k, lo, hi in rows], SHAPE)


def brute(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and y[1] is not None and x[1] <= y[2] and y[1] <= x[2])


def mixed(seed, n, first=0):
    """Points, short, nested and whole-space ranges, many of them with the same bounds, and one without any."""
    r, out = random.Random(seed), [(first, None, None)]
    for k in range(1, n):
        lo = r.choice([0, 0, r.randrange(60)])
        hi = r.choice([lo, lo + r.randrange(5), 59 if lo < 59 else lo])
        out.append((first + k, b"%02d" % lo, b"%02d" % hi))
    return out


@pytest.mark.parametrize("cuts, block", [(256, 512), (5, 3), (1, 1)])
def test_overlapping_is_the_brute_force(spark, monkeypatch, cuts, block):
    monkeypatch.setattr(ranges, "CUTS", cuts)
    monkeypatch.setattr(ranges, "BLOCK", block, raising=False)
    monkeypatch.setattr(ranges, "PAIRS", 50, raising=False)
    a, b = mixed(1, 40), mixed(2, 25, 100)
    for x, y in ((a, b), (b, a), (a, []), ([], a), (a[:1], b), (a[1:2], b[1:2])):
        got = ranges.overlapping(files(spark, x), files(spark, y)).select("a.file_id", "b.file_id").collect()
        assert sorted(map(tuple, got)) == brute(x, y)
    one = files(spark, a)
    assert sorted(map(tuple, ranges.overlapping(one, one).select("a.file_id", "b.file_id").collect())) == brute(a, a)


def test_a_file_list_is_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for p in batches:
            seen.add(len(p))
            yield p

    rows = mixed(3, 31)[1:]
    made = files(spark, rows).mapInPandas(count, SHAPE)
    assert ranges.overlapping(made, made).count() == len(brute(rows, rows))
    assert seen.value == 30


def test_wide_files_are_paired_once(spark):
    """300 files of one key cut the space, and each of 5,000 reaches into all stretches: a pair tried in each of them makes 6,400,000,000 tries."""
    n, points = 5000, 300
    bound = F.when(F.col("file_id") >= n, F.format_string("k%03d", F.col("file_id") - n))
    rows = spark.range(n + points).withColumnRenamed("id", "file_id")
    wide = rows.select("file_id", F.encode(F.coalesce(bound, F.lit("a")), "UTF-8").alias("smallest"), F.encode(F.coalesce(bound, F.lit("z")), "UTF-8").alias("biggest"))
    start = time.time()
    assert ranges.overlapping(wide, wide).where("a.file_id < b.file_id").count() == n * (n - 1) // 2 + n * points
    assert time.time() - start < 25
