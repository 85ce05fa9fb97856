import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec as C
from tidelog.model import Options
from tidelog.operators.conflicts import Oracle, WaterMark


def test_internal_keys(spark):
    versions = [1, 5, 7, 1 << 62, (1 << 63) - 1]
    df = spark.createDataFrame([(bytearray(b"k\x00\xff"), v) for v in versions], "user_key binary, version long")
    out = df.select("version", C.key_with_ts().alias("internal_key")).select("*", C.user_key().alias("k"), C.version_of().alias("v")).collect()
    for r in out:
        assert bytes(r.internal_key) == b"k\x00\xff" + struct.pack(">Q", (1 << 64) - 1 - r.version)
        assert bytes(r.k) == b"k\x00\xff" and r.v == r.version
    order = df.select("version", C.key_with_ts().alias("x")).orderBy("x").collect()
    assert [r.version for r in order] == sorted(versions, reverse=True)


@given(st.binary(min_size=0, max_size=6), st.binary(min_size=0, max_size=8))
def test_prefix_end(prefix, key):
    end = C.prefix_end(prefix)
    assert key.startswith(prefix) == (key >= prefix and (end is None or key < end))


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("encode(cast(id AS string), 'UTF-8') AS user_key").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(C.has_prefix("user_key", b"1"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(user_key" in plan and "LessThan(user_key" in plan


def test_cells_pointers_and_records(spark):
    data = [(bytearray(b"key"), 255, 7, e, bytearray(v)) for e in (0, 1, 127, 128, 300, 1 << 40, (1 << 62) + 3) for v in (b"", b"x" * 300)]
    df = spark.createDataFrame(data, "user_key binary, meta int, user_meta int, expires_at long, value binary")
    cell = df.select("*", C.encode_value().alias("cell"), C.encoded_size().alias("size"), C.encode_log_entry().alias("record"))
    for r in cell.select("*", C.decode_value().alias("v"), C.decode_log_entry().alias("e")).collect():
        for got in (r.v, r.e):
            assert (got.meta, got.user_meta, got.expires_at, bytes(got.value)) == (r.meta, r.user_meta, r.expires_at, bytes(r.value))
        assert bytes(r.e.user_key) == b"key" and r.size == len(r.cell)
    p = spark.createDataFrame([((1, 2, 3),), ((2**31 - 1, 65536, 255),)], "value_ref struct<file_id:int,len:int,offset:int>")
    for r in p.select("value_ref", C.encode_pointer().alias("pointer")).select("*", C.decode_pointer().alias("back")).collect():
        assert bytes(r.pointer) == struct.pack("<III", *r.value_ref) and tuple(r.back) == tuple(r.value_ref)


def test_bytes_diff(spark):
    pairs = [(b"hello", b"helium"), (b"", b"a"), (b"abc", b"abc"), (b"abc", b"ab"), (b"x" * 20, b"x" * 25)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")
    assert [bytes(r[0]) for r in df.select(C.bytes_diff("a", "b")).collect()] == [b"ium", b"a", b"", b"", b"xxxxx"]


def test_checksums(spark):
    assert C.crc32c_of(b"123456789") == 0xE3069283 and C.crc32_of(b"123456789") == 0xCBF43926
    got = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b""),)], "v binary").select(C.xxh64("v").alias("h"), C.crc32("v").alias("c")).collect()
    assert got[0].h & (1 << 64) - 1 == 0xD24EC4F1A98C6E5B and got[1].c == 0


def test_estimate_and_separation():
    o = Options(dir="x")
    assert not o.separates(1023) and o.separates(1024) and not Options(dir="x", value_threshold=0).separates(10**9)


def test_watermark():
    w = WaterMark()
    w.begin(1, 2, 3)
    w.done(2, 3)
    assert w.done_until() == 0
    w.done(1)
    assert w.done_until() == 3 and w.last_index() == 3 and w.wait_for(3, 0)


def test_oracle_conflicts():
    o = Oracle()
    early = o.read_ts()  # an open reader keeps the commits after it
    for keys in ({b"11"}, {b"22"}, {b"33"}):
        o.done_commit(o.commit_ts(o.read_ts(), set(), keys))
    assert o.has_conflict(early, {b"11", b"23"}) and not o.has_conflict(early, {b"23"})
    assert o.has_conflict(2, {b"33"}) and not o.has_conflict(3, {b"33"})
    o.done_read(early)
    o.done_commit(o.commit_ts(o.read_ts(), set(), {b"44"}))
    assert set(o.committed) == {4} and o.discard_at_or_below() == 3


def test_xxh64_of_every_length(spark):
    xxhash = pytest.importorskip("xxhash")
    values = [bytes((7 * k + n) % 256 for k in range(n)) for n in range(100)]
    rows = spark.createDataFrame([(n, bytearray(v)) for n, v in enumerate(values)] + [(100, None)], "n int, v binary").select("n", C.xxh64("v").alias("h")).collect()
    for r in rows:
        want = None if r.n == 100 else int.from_bytes(xxhash.xxh64_digest(values[r.n], 0), "big", signed=True)
        assert r.h == want
