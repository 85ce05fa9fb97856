"""Removal of repeated byte strings with suffix arrays made by induced sorting.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else, in the same text or another; strings never cross texts, and all are
judged on the input. Segments of possible repeats are routed to shards (see
:mod:`.repeats`). A shard puts its segments together and builds their suffix
array: suffixes are classified as rising or falling, the leftmost rising ones
(LMS) are sorted by their substrings, equal substrings by a recursion on their
names, and all other suffixes are induced from them in two linear scans, a
bucket at a time. Names are given by comparing the substrings' bytes. Permuted
common prefixes come from the predecessor of each suffix: they are compared
only where the preceding bytes differ and fall by one elsewhere. A window whose
prefix in common with a neighbour reaches ``length`` is repeated.

Null and empty texts: nothing to remove. Texts shorter than ``length``: whole.
Very long texts are judged whole; a task holds the text and a few times its
bytes, and a text of one repeated byte or word is one segment. Ties: which of
equal strings counts as first changes nothing, since all of them go. Repeated
rows and equal texts: all their bytes go, in every copy. Null doc_id: like any
other. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same_bytes, slices
from .repeats import Plan, flags_to_runs, spans, with_text

LENGTH, GRAM = 400, 32
#: Common prefixes longer than this are measured pair by pair.
FAR = 4096
#: UTF-8 never has this byte.
STOP = 0xFF


def rising(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S-type); the last one is not, the end being smallest."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    change = np.flatnonzero(t[1:] != t[:-1])  # t[i] != t[i+1]
    nxt = np.searchsorted(change, np.arange(n))
    has = nxt < len(change)
    at = change[np.minimum(nxt, max(len(change) - 1, 0))] if len(change) else np.zeros(n, np.int64)
    out[has] = t[at[has]] < t[at[has] + 1]
    return out


def _induce(t: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array in which the LMS suffixes keep the order given, by two scans over the buckets.

    A bucket's suffixes that precede one of the same bucket stand in stretches of its
    symbol, so all of them are put down at once: first those next to what was there, then
    those two places before it, and so on."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(t, minlength=sigma)
    tail = np.cumsum(size)
    head = tail - size
    c = t[lms]
    grouped = lms[np.argsort(c, kind="stable")]
    n_lms = np.bincount(c, minlength=sigma)
    upto = np.cumsum(n_lms)
    new = np.ones(n, bool)
    new[1:] = t[1:] != t[:-1]
    stretch = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of each symbol's stretch

    def deal(j: np.ndarray, ptr: np.ndarray, step: int) -> None:
        """Append to buckets in the order given, upward or downward from their pointers."""
        if not len(j):
            return
        ch = t[j]
        o = np.argsort(ch, kind="stable")
        sc = ch[o]
        at = np.flatnonzero(np.concatenate(([True], sc[1:] != sc[:-1])))
        count = np.diff(np.append(at, len(sc)))
        rank = np.arange(len(o)) - np.repeat(at, count)
        sa[ptr[sc] + step * rank] = j[o]
        ptr[sc[at]] += step * count

    def unrolled(j: np.ndarray) -> np.ndarray:
        """The given suffixes of one bucket and those that reach them through its own symbol, in waves."""
        count = j - stretch[j] + 1
        if not len(j) or count.max() == 1:
            return j
        item = np.repeat(np.arange(len(j)), count)
        wave = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        o = np.argsort(wave, kind="stable")
        return j[item[o]] - wave[o]

    # left to right: falling suffixes behind what is already there
    ptr = head.copy()
    deal(np.array([n - 1]), ptr, 1)
    used = np.flatnonzero(size).tolist()
    for b in used:
        mine = unrolled(sa[head[b] : ptr[b]])
        sa[head[b] : head[b] + len(mine)] = mine
        ptr[b] = head[b] + len(mine)
        j = mine[mine > 0] - 1
        deal(j[t[j] > b], ptr, 1)
        deal(grouped[upto[b] - n_lms[b] : upto[b]] - 1, ptr, 1)
    # right to left: rising suffixes before what is already there
    falling_end = ptr
    ptr = tail - 1
    for b in reversed(used):
        mine = unrolled(sa[ptr[b] + 1 : tail[b]][::-1])
        sa[tail[b] - len(mine) : tail[b]] = mine[::-1]
        for batch in (mine, sa[head[b] : falling_end[b]][::-1]):
            j = batch[batch > 0] - 1
            deal(j[t[j] < b], ptr, -1)
    return sa


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string with many different symbols, which buckets would not help.

    Ranks are first places of groups of suffixes equal so far; each round sorts
    only groups of more than one by the rank of what follows, twice as far on."""
    n = len(t)
    sa = np.argsort(t)
    start = np.concatenate(([True], t[sa][1:] != t[sa][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    k = 1
    while True:
        alone = start & np.append(start[1:], True)
        place = np.flatnonzero(~alone)
        if not len(place):
            return sa
        mine = sa[place]
        group = rank[mine]
        key = group * (n + 1) + rank[np.minimum(mine + k, n)] + 1
        order = np.argsort(key)
        mine, key = mine[order], key[order]
        sa[place] = mine
        new = np.concatenate(([True], key[1:] != key[:-1]))
        start[place] = new
        rank[mine] = np.maximum.accumulate(np.where(new, place, 0))
        k *= 2


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Starts of the suffixes of ``t`` (values under ``sigma``) in order; a suffix precedes its extensions."""
    n = len(t)
    if n < 64:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s_type = rising(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    rough = _induce(t, lms, sigma)
    if len(lms) < 2:
        return rough
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # names of LMS substrings, each up to and with the next LMS symbol; the last one runs to the end and is its own
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    size = (np.append(lms[1:] + 1, n) - lms)[place[ordered]]
    size[place[ordered] == len(lms) - 1] = -1
    same = size[1:] == size[:-1]
    width, at = t.itemsize, np.flatnonzero(same)
    same[at] = same_bytes(t.view(np.uint8), width * ordered[at], width * ordered[at + 1], width * size[at])
    name = np.cumsum(np.concatenate(([0], ~same)))
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[place[ordered]] = name
        kinds = int(name[-1]) + 1
        ordered = lms[suffix_array(reduced, kinds) if kinds <= len(lms) // 64 else _by_doubling(reduced)]
    return _induce(t, ordered, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray, breaks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(predecessor of each suffix, length of their common prefix) in text order.

    Prefixes are exact up to ``most``. They are compared at starts of segments
    (``breaks``) and where the preceding symbols differ; in between each is one
    less than the one before."""
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    direct = np.ones(n, bool)
    i = np.flatnonzero((phi > 0))
    i = i[i > 0]
    direct[i] = t[i - 1] != t[phi[i] - 1]
    direct[breaks] = True
    at = np.flatnonzero(direct & (phi >= 0))
    length = np.zeros(len(at), np.int64)
    padded = np.concatenate((t, np.zeros(8, t.dtype)))
    eight = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
    alive, a, b = np.arange(len(at)), at, phi[at]
    while len(alive):
        if len(alive) and length[alive[0]] >= FAR:  # all that are left have come this far: compared one by one, a block at a time
            for k, p, q in zip(alive.tolist(), a.tolist(), b.tolist()):
                block, end = 1 << 12, n - max(p, q)
                done = 0
                while done < end and length[k] < most:
                    m = min(block, end - done)
                    x = t[p + done : p + done + m] != t[q + done : q + done + m]
                    if x.any():
                        length[k] += int(x.argmax())
                        break
                    length[k] += m
                    done, block = done + m, min(2 * block, 1 << 22)
            break
        room = n - np.maximum(a, b)
        x = eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]
        lowest = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, np.maximum(room, 0))
        length[alive] += same
        go = (same == 8) & (length[alive] < most)
        alive, a, b = alive[go], a[go] + 8, b[go] + 8
    best = np.full(n, -1, np.int64)
    best[at] = length + at
    # value minus position carries forward until the next direct one
    last = np.maximum.accumulate(np.where(direct, np.arange(n), 0))
    carried = best[last] - np.arange(n)
    return phi, np.where(phi >= 0, np.maximum(carried, 0), 0)


def match(data: list[bytes], n_occ: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Runs of windows of each segment that occur elsewhere: in it more than once, or in another segment."""
    joined = np.frombuffer(b"".join(x + bytes([STOP]) for x in data), np.uint8)
    size = np.array([len(x) + 1 for x in data], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    sa = suffix_array(joined)
    phi, lcp = common_prefixes(joined, sa, first[:-1], int(size.max()) + 8)
    flag = np.zeros(len(joined), bool)
    hit = np.flatnonzero(lcp >= length)
    flag[hit] = True
    flag[phi[hit]] = True
    out = []
    for k, n in enumerate(n_occ.tolist()):
        windows = int(size[k]) - length
        out.append([(0, windows)] if n > 1 else flags_to_runs(flag[first[k] : first[k] + windows]))
    return out


PLAN = Plan(LENGTH, GRAM, False, match, first_stays=False)


def _whole(sym) -> list[str]:
    return [hashlib.sha256(sym.buf[a:b].tobytes()).hexdigest() for a, b in zip(sym.first[:-1].tolist(), sym.first[1:].tolist())]


def _apply(batches):
    for rows, buf, off in slices(batches):
        out = []
        for k, spans_ in enumerate(rows.column("spans").to_pylist()):
            text = buf[off[k] : off[k + 1]]
            d = np.zeros(len(text) + 1, np.int32)
            np.add.at(d, [x["start"] for x in spans_], 1)
            np.subtract.at(d, [x["stop"] for x in spans_], 1)
            gone = np.cumsum(d[:-1]) > 0
            kept = text[~gone].tobytes()
            out.append((int(gone.sum()), len(flags_to_runs(gone)), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([rows.column("nid"), *(pa.array([x[k] for x in out], pa.int64()) for k in range(2)), pa.array([x[2] for x in out], pa.string())], names=["nid", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows, nodes, found = spans(docs, plan, _whole)
    alone = nodes.where("n_copies = 1")
    told = with_text(docs, alone, found).mapInArrow(_apply, "nid long, n_removed long, n_spans long, kept string")
    by_node = nodes.select("d", "nid", "n_copies").join(told.hint("merge"), "nid", "left").drop("nid")
    out = rows.join(by_node, "d")
    copied = (F.col("n_copies") > 1) & (F.col("n_units") >= plan.length)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        F.when(copied, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(empty)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
