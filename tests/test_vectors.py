"""Literal vectors of retention, snapshots, seeks and neighbours, and a procedural model against Spark."""

import re

import pytest

from tidelog import model as M
from tidelog.operators import ranges, retention, scan, snapshot
from tidelog.sources import datasets

NOW = 1_705_320_000_000


def rows(spark, text, value=None):
    """Entries from words like foo3 (version 3), foo3D (deleted) or foo10F (discards what is earlier)."""
    out = []
    for w in text.split():
        key, version, flag, val = re.fullmatch(r"([a-z]+?)(\d+)([DF]?)(?:=(\w+))?", w, re.I).groups()
        out.append((bytearray(key.encode()), int(version), {"D": 1, "F": 4, "": 0}[flag], 0, 0, bytearray((val or value or "v").encode())))
    return spark.createDataFrame(out, M.KV_SCHEMA)


def names(df, values=False):
    flag = {0: "", 1: "D", 4: "F"}
    return [f"{bytes(r.user_key).decode()}{r.version}{flag[r.meta]}" + (f"={bytes(r.value).decode()}" if values else "") for r in df.collect()]


@pytest.mark.parametrize(
    "given, discard, keep, overlap, want",
    [
        ("foo3 foo2 foo1 fooz1", 10, 1, False, "foo3 fooz1"),
        ("foo4 foo3 fooz1", 10, 1, False, "foo4 fooz1"),
        ("foo3D fooz1D foo2", 10, 1, True, "foo3D fooz1D"),
        ("foo3D foo2 fooz2D", 10, 1, True, "foo3D fooz2D"),
        ("foo3D fooz1D fooo2", 10, 1, False, "fooo2"),
        ("C3D A2 B2 C2 D2", 10, 1, False, "A2 B2 D2"),
        ("foo3 fooz1D foo2", 10, 2, True, "foo3 foo2 fooz1D"),
        ("foo3 foo2 fooz1D foo1", 10, 2, False, "foo3 foo2"),
        ("foo3 foo2 fooz1D foo1", 10, M.KEEP_ALL, False, "foo3 foo2 foo1"),
        ("foo4 foo3 foo2 fooz3", 1, 1, False, "foo4 foo3 foo2 fooz3"),
        ("foo4 foo3 foo2 foo1 fooz2", 3, 1, False, "foo4 foo3 fooz2"),
        ("foo4 foo3 foo2 fooz3", 10, 1, False, "foo4 fooz3"),
        ("foo10F foo9 foo4 foo3 foo2F foo1", 7, M.KEEP_ALL, False, "foo10F foo9 foo4 foo3 foo2F"),
    ],
)
def test_retention(spark, given, discard, keep, overlap, want):
    got = names(scan.ordered(retention.retain(rows(spark, given), discard, keep, NOW, overlap)))
    assert got == names(scan.ordered(rows(spark, want)))


def test_merge_precedence(spark):
    got = snapshot.merge([rows(spark, "foo4=bar"), rows(spark, "foo3=barNew fooz1=baz"), rows(spark, "foo3=bar")])
    assert names(scan.ordered(got), True) == ["foo4=bar", "foo3=barNew", "fooz1=baz"]
    with pytest.raises(ValueError):
        snapshot.merge([])


CHAIN = "a3=a3 a2=a2 b4D b3=b3 c2=c2 c1=c1"


@pytest.mark.parametrize("ts, want", [(4, "a3 c2"), (3, "a3 b3 c2"), (2, "a2 c2"), (1, "c1")])
def test_snapshots(spark, ts, want):
    df = rows(spark, CHAIN)
    assert names(scan.scan(df, ts, NOW)) == want.split()
    assert names(scan.scan(df, ts, NOW, reverse=True)) == want.split()[::-1]


def test_overlay(spark):
    mine = rows(spark, "b0=b4 c0D")
    got = snapshot.read_your_writes(rows(spark, CHAIN), mine, 3, NOW)
    assert names(scan.ordered(got), True) == ["a3=a3", "b3=b4"]


def test_all_versions_with_deletes(spark):
    df = rows(spark, "key1 key2D key3 key4D")
    assert names(scan.all_versions(df, 10)) == ["key4D", "key3", "key2D", "key1"]
    assert names(scan.all_versions(df, 10, reverse=True)) == ["key1", "key2D", "key3", "key4D"]


@pytest.mark.parametrize(
    "mine, reverse, key, want",
    [
        (False, False, "ab", "abcabcabc"),
        (False, False, "ac", "acdacdacd"),
        (False, False, "", "abcabcabc"),
        (True, False, "abbbbbbb", "abcabcabc"),
        (True, False, "accccccc", "adeadeade"),
        (True, False, "", "abcabcabc"),
        (False, True, "ac", "abcabcabc"),
        (False, True, "ad", "acdacdacd"),
        (False, True, "", "acdacdacd"),
        (True, True, "addddddd", "abcabcabc"),
        (True, True, "aeeeeeee", "adeadeade"),
        (True, True, "", "adeadeade"),
        (True, True, "accccccc", "abcabcabc"),
    ],
)
def test_seek(spark, mine, reverse, key, want):
    df = rows(spark, "abcabcabc2 acdacdacd1")
    if mine:
        df = snapshot.first_wins(snapshot.overlay(df, rows(spark, "adeadeade0 acdacdacd0D"), 9), "_prio").drop("_prio")
    got = scan.seek(df, key.encode(), 9, NOW, reverse, 1)
    assert [bytes(r.user_key).decode() for r in got.collect()] == [want]


def test_neighbours(spark):
    df = spark.range(1000).selectExpr("encode(format_string('%05d', id * 10 + 5), 'UTF-8') AS user_key")
    want = {
        "00001": "00005 00005 - -",
        "00005": "00015 00005 - 00005",
        "05555": "05565 05555 05545 05555",
        "05558": "05565 05565 05555 05555",
        "09995": "- 09995 09985 09995",
        "59995": "- - 09995 09995",
    }
    got = {p: [] for p in want}
    for kind in ("gt", "ge", "lt", "le"):
        for r in scan.nearest(df, [p.encode() for p in want], kind).collect():
            got[bytes(r.probe).decode()].append(bytes(r.found).decode() if r.found else "-")
    assert {p: " ".join(v) for p, v in got.items()} == want


def test_range_algebra():
    R = ranges.KeyRange
    a, b, c, d = R(b"0", b"dddd"), R(b"eeee", b"ffff"), R(b"0", b"eeee"), R(b"dddd", b"ffff")
    assert not a.overlaps(b) and not b.overlaps(a) and a.extend(b) == R(b"0", b"ffff")
    assert c.overlaps(d) and d.overlaps(c) and c.extend(d) == R(b"0", b"ffff")
    assert a.extend(ranges.INFINITE).infinite and ranges.EMPTY.extend(a) == a and a.extend(ranges.EMPTY) == a
    assert ranges.EMPTY.overlaps(a) and ranges.EMPTY.overlaps(ranges.INFINITE) and not ranges.INFINITE.overlaps(ranges.EMPTY) and not a.overlaps(ranges.EMPTY)


def model(entries, discard, keep, overlap):
    """The retention rule, one row after the other."""
    out, key, skip, n = [], None, False, 0
    for k, v, meta, exp in sorted(entries, key=lambda x: (x[0], -x[1])):
        if k != key:
            key, skip, n = k, False, 0
        if skip:
            continue
        if v > discard or meta & 8:
            out.append((k, v))
            continue
        n += 1
        gone = bool(meta & 1) or exp != 0 and exp <= NOW
        last = bool(meta & 4) or n == keep
        skip = gone or last
        if not gone or overlap:
            out.append((k, v))
    return sorted(out)


@pytest.mark.parametrize("discard", [0, 333, 1000])
@pytest.mark.parametrize("keep", [1, 2, M.KEEP_ALL])
@pytest.mark.parametrize("overlap", [False, True])
def test_retention_model(spark, sf, discard, keep, overlap):
    df = datasets.kv_events(spark, sf).selectExpr("*", "meta + if(version % 5 = 0, 8, 0) AS m2").drop("meta").withColumnRenamed("m2", "meta")
    entries = [(bytes(r.user_key), r.version, r.meta, r.expires_at) for r in df.collect()]
    for form in (retention.retain, retention.retain_hot):
        got = form(df, discard, keep, NOW, overlap).select("user_key", "version").collect()
        assert sorted((bytes(r.user_key), r.version) for r in got) == model(entries, discard, keep, overlap)


@pytest.mark.parametrize("discard, keep, overlap", [(500, 1, False), (333, 2, True), (1000, 5, False)])
def test_compaction_keeps_later_snapshots(spark, sf, discard, keep, overlap):
    df = datasets.kv_events(spark, sf)
    small = retention.retain(df, discard, keep, NOW, overlap)
    for ts in (discard, 800, 1000):
        if ts >= discard:
            assert names(scan.scan(small, ts, NOW), True) == names(scan.scan(df, ts, NOW), True)
