"""Routing of repeated windows: the part that suffix-array and automaton dedup share.

A window is ``length`` consecutive symbols of one text. Its key is the smallest
``gram``-symbol hash in it, so equal windows have equal keys. Consecutive
windows with one key form a run, and the symbols a run covers are its segment.
Only runs whose key stands at two places of the corpus go further; their
segments are routed by it, so all copies of a window meet in one group,
whichever texts they come from. Equal segments of a group (equal in a 128-bit
digest) are one row with a count. The place of the smallest hash, leftmost on
ties, is a window's anchor; in a run of which all windows have one anchor no
window occurs twice, the others are marked ``many``.

A group with more than ``cap`` different segments, or more than ``cap_bytes`` of
them, is split: its windows are cut into ranges of the anchor's offset of a
smaller width, and a range is routed by the hash of the symbols that all its
windows share. Equal ranges of one segment are settled on the spot. Widths fall
to one, where that is the window itself: there a count and the first place of
each window decide, and no segment is compared any more. So no group grows
without bound, nothing is dropped, and a text of one repeated word or byte is
one segment at every width.

Equal texts are one node beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, even_hash, exact, free_shuffles, mix, partitions, prefix_hash, sliding_min, span_hash, texts, words

#: Different segments that one group may hold, and bytes of segments in one shard.
CAP, SHARD_BYTES = 500, 1 << 20
#: Windows looked at once, and bytes of segments handed on at once.
PIECE, BATCH_BYTES = 1 << 20, 16 << 20
#: Windows from which a segment is looked at for a period.
UNROLL = 4096
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Plan:
    length: int
    gram: int
    by_words: bool
    #: A shard's segments (data and n_occ, in order of first occurrence) to
    #: a list, for each, of (first, stop) runs of windows that occur before or elsewhere.
    match: Callable
    #: Whether a window's first occurrence stays.
    first_stays: bool
    cap: int = CAP
    cap_bytes: int = SHARD_BYTES

    @property
    def span(self) -> int:
        return self.length - self.gram + 1


def normal(buf: np.ndarray, off: np.ndarray):
    """Words of a slice put together with one space after each: (bytes, word starts, word ends, first word of each text)."""
    w = words(buf, off, hashed=False)
    keep = np.zeros(len(buf) + 1, bool)
    d = np.zeros(len(buf) + 1, np.int8)
    np.add.at(d, w.starts, 1)
    np.subtract.at(d, w.ends, 1)
    keep[:-1] = np.cumsum(d[:-1]) > 0
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = buf[keep[:-1]]
    return out, starts, ends, w.first


class Symbols:
    """Symbols of the texts of a slice: windows and their keys, and the bytes of any stretch."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, plan: Plan):
        self.plan = plan
        if plan.by_words:
            self.buf, self.starts, self.ends, self.first = normal(buf, off)
        else:
            self.buf, self.first = buf, off

    def edges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte span of symbols a to b (end exclusive, not empty)."""
        return (self.starts[a], self.ends[b - 1]) if self.plan.by_words else (a, b)

    def piece(self, a: int, b: int):
        """Of windows a to b, text edges ignored: (anchors, keys, running sums of their bytes, first byte)."""
        k, last = self.plan.gram, b - 1 + self.plan.length
        lo, hi = self.edges(a, last)
        pre = prefix_hash(self.buf[lo:hi])
        n = last - a - k + 1
        g = span_hash(pre, self.starts[a : a + n] - lo, self.ends[a + k - 1 : last] - lo) if self.plan.by_words else even_hash(pre, k)
        # order by the hash's upper half, then by place
        low = sliding_min((g & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), self.plan.span)
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return anchor + a, g[anchor], pre, int(lo)

    def runs(self):
        """(text, key, first window, windows, many) of every run, places counted from the text's first symbol."""
        first, length = self.first, self.plan.length
        total = int(first[-1]) - length + 1
        parts = []
        end = np.repeat(first[1:], np.diff(first)) if total > 0 else None
        for a in range(0, total, PIECE):
            b = min(total, a + PIECE)
            anchor, key, _, _ = self.piece(a, b)
            start = np.flatnonzero(np.arange(a + length, b + length) <= end[a:b])
            if not len(start):
                continue
            anchor, key, start = anchor[start], key[start], start + a
            new = np.ones(len(start), bool)
            new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
            begin = np.flatnonzero(new)
            finish = np.append(begin[1:], len(start)) - 1
            parts.append((key[begin], start[begin], finish - begin + 1, anchor[begin], anchor[finish]))
        if not parts:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
        key, s, n, a0, a1 = (np.concatenate(x) for x in zip(*parts))
        if len(parts) > 1:  # runs that go on in the next piece
            new = np.ones(len(s), bool)
            new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1] + n[:-1])
            at = np.flatnonzero(new)
            finish = np.append(at[1:], len(s)) - 1
            key, s, n, a0, a1 = key[at], s[at], np.add.reduceat(n, at), a0[at], a1[finish]
        doc = np.searchsorted(first, s, "right") - 1
        return doc, key, s - first[doc], n, a0 != a1

    def ranges(self, width: int):
        """Windows of one text as runs of equal keys at a width: (key, first window, windows, many, core first symbol, core end)."""
        length = self.plan.length
        total = int(self.first[-1]) - length + 1
        parts = []
        for a in range(0, total, PIECE):
            b = min(total, a + PIECE)
            anchor, _, pre, base = self.piece(a, b)
            k = np.arange(a, b)
            r = (anchor - k) // width
            new = np.ones(len(k), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(k)))
            anchor, r, k = anchor[at], r[at], k[at]
            one, two = anchor - r * width, anchor - (r * width + width - 1) + length
            lo, hi = self.edges(one, two)
            key = mix(span_hash(pre, lo - base, hi - base) ^ mix((r * 1_000_003 + width).astype(np.uint64)))
            parts.append((key, k, n, one, two, anchor))
        key, s, n, one, two, anchor = (np.concatenate(x) for x in zip(*parts))
        new = np.ones(len(s), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        finish = np.append(at[1:], len(s)) - 1
        return key[at], s[at], np.add.reduceat(n, at), anchor[at] != anchor[finish], one[at], two[at]


def _find(plan: Plan, whole: Callable):
    """Rows of texts to rows of their runs; ``whole`` hashes a text of which nothing is removed."""
    kind = pa.struct([("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("many", pa.bool_())])

    def run(batches):
        from .common import slices

        for rows, buf, off in slices(batches):
            sym = Symbols(buf, off, plan)
            doc, h, s, n, many = sym.runs()
            ends = np.searchsorted(doc, np.arange(len(off))).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(many)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("d"), pa.array(np.diff(sym.first)), pa.array(whole(sym), pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "d", "n_units", "whole", "runs"])

    return run


_RUNS = "array<struct<h:long,s:int,n:int,many:boolean>>"
_SEGMENT = "key long, sh binary, n int, many boolean, data binary, own long, nid long, s int, weight int, settled boolean"
_KINDS = pa.schema([("key", pa.int64()), ("sh", pa.binary()), ("n", pa.int32()), ("many", pa.bool_()), ("data", pa.binary()), ("own", pa.int64()), ("nid", pa.int64()), ("s", pa.int32()), ("weight", pa.int32()), ("settled", pa.bool_())])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def longest_run(flags: np.ndarray) -> tuple[int, int]:
    """(first, stop) of the longest stretch of True, empty if there is none."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return (int(a[k]), int(b[k])) if len(a) and (k := int((b - a).argmax())) >= 0 else (0, 0)


def unrolled(sym: Symbols, n: int) -> list[tuple[int, int, int, bool]]:
    """A long segment in which windows may occur again, as (first window, windows, weight, settled) parts.

    Where it goes on in one period, as anchors at equal distances tell and a
    comparison with itself proves, only the windows of the first period are left,
    and all later ones of that stretch are settled."""
    length, todo, out = sym.plan.length, [(0, n)], []
    number = exact(sym.buf, sym.starts, sym.ends, span_hash(prefix_hash(sym.buf), sym.starts, sym.ends))[0] if sym.plan.by_words else sym.buf
    while todo:
        a, b = todo.pop()
        if b <= a:
            continue
        p = 0
        if b - a > UNROLL:
            mid = (a + b) // 2
            apart = np.diff(np.unique(sym.piece(max(a, mid - PIECE // 2), min(b, mid + PIECE // 2))[0]))
            p = int(np.bincount(apart).argmax()) if len(apart) and apart.max() < PIECE else 0
        if p:
            mine = number[a : b - 1 + length]
            x, y = longest_run(mine[:-p] == mine[p:])
            last = y + p - length  # the last window of the stretch
            if last - x + 1 >= max(2 * p, (b - a) // 8):
                out += [(a + x, p, 2, False), (a + x + p, last + 1 - x - p, 1, True)]
                todo += [(a, a + x), (a + last + 1, b)]
                continue
        out.append((a, b - a, 1, False))
    return out


def _cut_out(plan: Plan):
    """Joined rows (nid, own, text, runs) to segments, in batches of bounded bytes."""

    def run(batches):
        from .common import slices

        for rows, buf, off in slices(batches):
            sym = Symbols(buf, off, plan)
            lists = rows.column("runs")
            n_runs = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            doc = np.repeat(np.arange(rows.num_rows), n_runs)
            h, s, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            many = flat.field(3)
            if not len(h):
                continue
            a = s + sym.first[doc]
            weight, settled = np.ones(len(h), np.int32), np.zeros(len(h), bool)
            far = np.flatnonzero(many.to_numpy(zero_copy_only=False) & (n > UNROLL))
            if len(far):
                rest = np.setdiff1d(np.arange(len(h)), far)
                of, off_, num, wt, done = [rest], [np.zeros(len(rest), np.int64)], [n[rest]], [weight[rest]], [settled[rest]]
                for k in far.tolist():
                    x, y = sym.edges(a[k], a[k] + n[k] - 1 + plan.length)
                    parts = np.array(unrolled(Symbols(sym.buf[x:y], np.array([0, y - x]), plan), int(n[k])), np.int64).reshape(-1, 4)
                    for to, v in zip((of, off_, num, wt, done), (np.full(len(parts), k), *parts.T)):
                        to.append(v)
                of, off_, n, weight, settled = (np.concatenate(x) for x in (of, off_, num, wt, done))
                h, doc, s, a, many, settled = h[of], doc[of], s[of] + off_, a[of] + off_, many.take(pa.array(of)), settled.astype(bool)
            lo, hi = sym.edges(a, a + n - 1 + plan.length)
            hi = np.where(settled, lo, hi)  # what is settled needs no bytes
            own, nid = rows.column("own"), rows.column("nid")
            for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(np.cumsum(hi - lo) // BATCH_BYTES)) + 1):
                data = [sym.buf[x:y].tobytes() for x, y in zip(lo[part].tolist(), hi[part].tolist())]
                take = pa.array(doc[part])
                columns = [pa.array(h[part]), pa.array([digest(x) for x in data], pa.binary()), pa.array(n[part].astype(np.int32)), many.take(pa.array(part)), pa.array(data, pa.binary()), own.take(take), nid.take(take), pa.array(s[part].astype(np.int32)), pa.array(weight[part].astype(np.int32)), pa.array(settled[part])]
                yield pa.RecordBatch.from_arrays(columns, schema=_KINDS)

    return run


def _split(plan: Plan, width: int):
    """Different segments to segments of offset ranges of ``width``, keyed by what a range's windows
    share. A range that stands more than once weighs two, its place is that of its first occurrence;
    the other places in the same segment are settled. At width one nothing is compared later, so
    a range is named by its window and carries no bytes."""

    def run(batches):
        for rows in batches:
            out: dict[str, list] = {x: [] for x in _KINDS.names}
            size = 0
            for data, f, n_occ, many in zip(*(rows.column(k).to_pylist() for k in ("data", "f", "n_occ", "many"))):
                sym = Symbols(np.frombuffer(data, np.uint8), np.array([0, len(data)]), plan)
                key, s, n, twice, one, two = sym.ranges(width)
                lo, hi = sym.edges(s, s + n - 1 + plan.length)
                kinds, firsts = exact(sym.buf, lo, hi, span_hash(prefix_hash(sym.buf), lo, hi)) if many else (np.arange(len(s)), np.arange(len(s)))
                alone = np.zeros(len(s), bool)
                alone[firsts] = True
                count = np.bincount(kinds, minlength=len(firsts))[kinds]
                core_lo, core_hi = sym.edges(one, two)

                def add(k: int, windows: int, part: bytes, name: bytes, done: bool) -> None:
                    row = (int(key[k].view(np.int64)), name, windows, bool(twice[k]), part, f["own"], f["nid"], f["s"] + int(s[k]), 2 if n_occ > 1 or count[k] > 1 else 1, done)
                    for x, v in zip(out.values(), row):
                        x.append(v)

                for k in np.flatnonzero(alone).tolist():
                    part = sym.buf[lo[k] : hi[k]].tobytes()
                    name = digest(sym.buf[core_lo[k] : core_hi[k]].tobytes()) if width == 1 else digest(part)
                    add(k, int(n[k]), part if width > 1 else b"", name, False)
                    size += len(part)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict(out, schema=_KINDS)
                        out, size = {x: [] for x in out}, 0
                # neighbouring ranges that are settled are one
                d = np.diff(np.concatenate(([1], alone.astype(np.int8), [1])))
                for k, j in zip(np.flatnonzero(d == -1).tolist(), np.flatnonzero(d == 1).tolist()):
                    add(k, int(s[j - 1] + n[j - 1] - s[k]), b"", b"", True)
            yield pa.RecordBatch.from_pydict(out, schema=_KINDS)

    return run


def widths(plan: Plan) -> list[int]:
    out, w = [], plan.span
    while w > 1:
        w = max(1, w // 8)
        out.append(w)
    return out


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: always shuffled, so that no size changes the plan."""
    return df.hint("merge")


def _tidy(*frames: DataFrame) -> None:
    """Delete finished tables."""
    for x in frames:
        drop_cut(x)


def spans(docs: DataFrame, plan: Plan, whole: Callable):
    """Three tables: ``rows`` (doc_id, d, n_units, whole: one for a row of ``docs``), ``nodes``
    (nid, d, owner, n_owner, n_copies: one for a different text), and ``found`` (nid, spans
    of symbols that repeated windows of the node cover, in any order, overlapping)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    base = texts(docs).withColumn("d", F.unhex(F.md5("text")))
    found = base.mapInArrow(_find(plan, whole), f"doc_id long, d binary, n_units long, whole string, runs {_RUNS}")
    every = cut(found.withColumn("nid", F.monotonically_increasing_id()))
    ids = every.groupBy("d", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("nid"))
    one = ids.groupBy("d").agg(F.min_by(F.struct("doc_id", "n", "nid"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("x"), F.sum("n").alias("n_copies"))
    nodes = cut(one.select("x.nid", "d", F.col("x.doc_id").alias("owner"), F.col("x.n").alias("n_owner"), "n_copies"))
    rows = cut(every.drop("runs", "nid"))

    # a key is repeated if it stands at two places of one text or in two texts; copies of a text agree in both
    run = every.select("nid", F.xxhash64("d").alias("dh"), F.inline("runs"))
    place = F.xxhash64("dh", "s")
    # a table of its own, so that the join's two sides are plain exchanges, which Spark splits where a hash is hot
    twice = cut(run.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("many").alias("many")).where("lo <> hi OR many").select("h"))
    free_shuffles(spark)
    owners = nodes.select("nid")
    again = cut(run.drop("dh").join(_large(twice), "h").join(_large(owners), "nid", "left_semi").groupBy("nid").agg(F.collect_list(F.struct("h", "s", "n", "many")).alias("runs")))
    _tidy(every, twice)
    names = nodes.select("nid", "d", "owner", "n_owner")
    wanted = again.join(_large(names), "nid").select("nid", F.col("d").alias("_d"), F.col("owner").alias("_id"), F.coalesce("owner", F.lit(LAST)).alias("own"), "runs")
    met = base.join(_large(wanted), (base["d"] == wanted["_d"]) & base["doc_id"].eqNullSafe(wanted["_id"])).select("nid", "own", "text", "runs")
    if nodes.where("n_owner > 1").limit(1).count():
        met = met.dropDuplicates(["nid"])
    made = cut(met.mapInArrow(_cut_out(plan), _SEGMENT))
    _tidy(again)
    free_shuffles(spark)

    parts_found = []
    none = F.array().cast("array<struct<a:int,b:int>>")
    for width in [*widths(plan), 0]:
        segments = made.where("NOT settled")
        first = F.min(F.struct("own", "nid", "s", "n")).alias("f")
        kinds = cut(segments.groupBy("key", "sh").agg(first, F.sum("weight").alias("n_occ"), F.first("data").alias("data"), F.max("many").alias("many")))
        free_shuffles(spark)
        named = ("key", "sh", F.col("f.nid").alias("f_nid"), F.col("f.s").alias("f_s"))
        hot, more = None, False
        gone = [made, kinds]
        if not width:
            # every segment of a group holds one window only, so the first place of it decides
            told = cut(kinds.where("n_occ > 1 OR many").select(*named, F.array(F.struct(F.lit(1).alias("a"), F.col("f.n").alias("b"))).alias("runs"), F.lit(True).alias("all_over")))
        else:
            group = cut(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.length("data")).alias("bytes"), F.sum("n_occ").alias("all_occ"), F.max("many").alias("many")).where("all_occ > 1 OR many"))
            gone.append(group)
            is_large = (F.col("kinds") > plan.cap) | (F.col("bytes") > plan.cap_bytes)
            large = group.where(is_large).select("key")
            more = large.limit(1).count() > 0
            small = kinds.join(_large(group.where(~is_large).select("key")), "key")
            total = group.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
            shards = max(parts, total // SHARD_BYTES)
            told = small.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(_match(plan), "key long, sh binary, f_nid long, f_s int, runs array<struct<a:int,b:int>>, all_over boolean")
            if more:
                # what occurs more than once is settled for its other occurrences; the first one's windows go on in ranges
                hot = cut(kinds.join(_large(large), "key"))
                gone.append(hot)
                told = told.unionByName(hot.where("n_occ > 1").select(*named, none.alias("runs"), F.lit(True).alias("all_over")))
            told = cut(told)
        gone.append(told)
        free_shuffles(spark)
        seen = segments.select("key", "sh", "nid", "s", "n").join(_large(told), ["key", "sh"])
        all_of_it = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
        mine = (F.col("nid") == F.col("f_nid")) & (F.col("s") == F.col("f_s"))
        which = F.when(mine, F.col("runs")).otherwise(all_of_it) if plan.first_stays else F.when(F.col("all_over"), all_of_it).otherwise(F.col("runs"))
        hit = seen.select("nid", "s", F.inline(which)).where("a < b").unionByName(made.where("settled").select("nid", "s", F.lit(0).alias("a"), F.col("n").alias("b")))
        parts_found.append(cut(hit.select("nid", (F.col("s") + F.col("a")).alias("start"), (F.col("s") + F.col("b") - 1 + plan.length).alias("stop"))))
        if more:
            made = cut(hot.select("data", "f", "n_occ", "many").mapInArrow(_split(plan, width), _SEGMENT))
        _tidy(*gone)
        free_shuffles(spark)
        if not more:
            break
    flat = parts_found[0]
    for x in parts_found[1:]:
        flat = flat.unionByName(x)
    found = flat.groupBy("nid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows, nodes, found


def _match(plan: Plan):
    def run(shard: pa.Table) -> pa.Table:
        f = shard.column("f").combine_chunks()
        own, nid, s = (f.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        order = np.lexsort((s, nid, own))
        shard = shard.take(pa.array(order))
        nid, s = nid[order], s[order]
        n_occ = shard.column("n_occ").to_numpy()
        runs = plan.match(shard.column("data").to_pylist(), n_occ)
        keep = np.array([bool(r) or (c > 1) for r, c in zip(runs, n_occ.tolist())], bool)
        out = shard.select(["key", "sh"]).append_column("f_nid", pa.array(nid.astype(np.int64))).append_column("f_s", pa.array(s.astype(np.int32)))
        out = out.append_column("runs", pa.array([[{"a": a, "b": b} for a, b in r] for r in runs], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))))
        return out.append_column("all_over", pa.array(n_occ > 1)).filter(pa.array(keep))

    return run


def with_text(docs: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(nid, text, spans) of the nodes that have spans."""
    base = texts(docs).withColumn("d", F.unhex(F.md5("text")))
    wanted = found.join(_large(nodes), "nid").select("nid", F.col("d").alias("_d"), F.col("owner").alias("_id"), "spans")
    out = base.join(_large(wanted), (base["d"] == wanted["_d"]) & base["doc_id"].eqNullSafe(wanted["_id"])).select("nid", "text", "spans")
    return out.dropDuplicates(["nid"]) if nodes.where("n_owner > 1").limit(1).count() else out


def flags_to_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (first, stop) stretches of True."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))
