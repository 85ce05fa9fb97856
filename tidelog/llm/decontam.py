"""Benchmark decontamination with spaced seeds.

A seed is a fixed 0/1 mask over consecutive tokens; only the tokens under a 1
enter its hash, so a passage with a replaced token still meets its source under
a mask that ignores that place. Hashes of the test items are joined with those
of the texts, and each meeting is verified on its whole diagonal: the best run
there must be at least ``share`` of the item's tokens or ``RUN`` tokens, with at
least ``match`` of its tokens equal.

The masks alone miss passages whose every seed is hit by a substitution. So each
item is also sought by all its runs of ``stretch`` tokens: a run that the rule
accepts has so few substitutions that one stretch of that many equal tokens must
lie between two of them. Nothing that the rule accepts is missed.

Tokens are lower-cased words with ASCII punctuation left out. Hashes bring
tokens together, their bytes decide whether they are equal. The test items are
held in blocks of at most ``block_windows`` seed windows; each block is
broadcast, so what is broadcast has that bound whatever the size of the
benchmark. Where an item and a text repeat a token or a phrase, every diagonal
between them is a meeting: meetings are made and counted in bounded steps, and
only diagonals that can still win are verified.

Null or empty texts and items: never a hit. Very long texts are searched whole.
Ties: of a text's passages of one item the one with most equal tokens counts, of
those the one on the first diagonal, and there the longest run that starts
first. Repeated rows: each gives its own hits. Empty tables: no hits. Columns
other than the id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, buffer_of, mix, slices, texts, words

#: Masks over token positions, of different weights and spans.
MASKS = ("11110111", "1101100110101", "1110010110010011")
SHARE, MATCH = 0.8, 0.8
#: A run of so many tokens counts whatever its share of the item.
RUN = 50
BLOCK_WINDOWS = 2_000_000
#: Token pairs compared at once.
PAIRS = 1 << 21

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def tokens(arr) -> tuple:
    """(token hashes, words) of an Arrow string array; words of punctuation alone are no tokens."""
    buf, off = buffer_of(pc.utf8_lower(arr))
    gone = _PUNCT[buf]
    kept = np.concatenate(([0], np.cumsum(~gone)))
    clean, off2 = buf[~gone], kept[off]
    return words(clean, off2)


def seed_hashes(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under one mask at every start whose whole span lies in one text, and those starts."""
    span, n = len(mask), len(h)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n - span + 1, int(mask, 2), np.uint64)
    for k in (k for k, c in enumerate(mask) if c == "1"):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : n - span + 1 + k]
    ok = np.ones(n - span + 1, bool)
    edge = first[1:-1]
    for k in range(1, span):
        at = edge - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def best_run(equal: np.ndarray, match: float) -> tuple[int, int, int]:
    """(length, start, end) of the longest run that starts and ends on an equal token and has at least ``match`` equal ones."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    # a run from the i-th to the j-th equal token is good if gain[j] + 1 - match >= gain[i]
    gain = np.arange(len(at)) - match * at
    lowest = np.minimum.accumulate(gain)
    i = np.searchsorted(-lowest, -(gain + 1 - match + 1e-9))  # the first token that the j-th may start from
    length = at - at[i] + 1
    j = int(length.argmax())
    return int(length[j]), int(at[i[j]]), int(at[j]) + 1


def needed(n: int, share: float) -> int:
    """Least length of a run that counts, of an item of n tokens."""
    return max(1, min(math.ceil(share * n - 1e-9), RUN))


def stretch(n: int, share: float, match: float) -> int:
    """Equal neighbouring tokens that every run that counts must hold, of an item of n tokens."""
    wrong = [(size, math.floor((1 - match) * size + 1e-9)) for size in range(needed(n, share), n + 1)]
    return min(-(-(size - e) // (e + 1)) for size, e in wrong)


def spelled(w) -> list[bytes]:
    return [w.buf[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist())]


class Block:
    """Seed hashes of some test items, sorted, for lookup. ``words`` has the tokens themselves, one list for an item."""

    def __init__(self, ids: list, items: list[np.ndarray], masks, share: float = SHARE, match: float = MATCH, words: list[list[bytes]] | None = None):
        self.ids, self.items, self.words, self.share, self.match = ids, items, words, share, match
        flat = np.concatenate(items) if items else np.zeros(0, np.uint64)
        first = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)
        self.flat, self.first = flat, first
        self.size = np.diff(first)
        #: Equal tokens of the shortest run that counts, by item.
        self.least = np.array([math.ceil(match * needed(n, share) - 1e-9) for n in self.size.tolist()], np.int64)
        known = {n: stretch(n, share, match) for n in set(self.size.tolist()) - {0}}
        runs = np.array([known.get(n, 0) for n in self.size.tolist()], np.int64)
        self.by_mask = []
        for mask, mine in [*((m, runs > 0) for m in masks), *(("1" * k, runs == k) for k in sorted(set(known.values())))]:
            h, at = seed_hashes(flat, first, mask)
            item = np.searchsorted(first, at, "right") - 1
            ok = mine[item] if len(item) else np.zeros(0, bool)
            h, at, item = h[ok], at[ok], item[ok]
            order = np.argsort(h, kind="stable")
            self.by_mask.append((mask, h[order], item[order], (at - first[item])[order]))

    def meetings(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, text place of the item's first token) of every diagonal on which a seed meets."""
        width, n_items = len(h) + len(self.flat) + 1, max(1, len(self.items))
        found = [np.zeros(0, np.int64)]

        def add(text, item, start) -> None:
            found.append(np.unique((text * n_items + item) * width + start + len(self.flat)))

        for mask, keys, items, at in self.by_mask:
            if not len(keys):
                continue
            g, starts = seed_hashes(h, first, mask)
            lo = np.searchsorted(keys, g, "left")
            met = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == g))
            if not len(met):
                continue
            lo, starts = lo[met], starts[met]
            n = np.searchsorted(keys, g[met], "right") - lo
            text = np.searchsorted(first, starts, "right") - 1
            # a seed that text and item repeat: the text's places are shifted by each of the item's
            pairs = np.bincount(lo, weights=n, minlength=1)
            hot = (pairs > PAIRS)[lo]
            for x in np.unique(lo[hot]).tolist():
                mine = np.flatnonzero(lo == x)
                same = slice(x, x + int(n[mine[0]]))
                for t in np.unique(text[mine]).tolist():
                    places = starts[mine[text[mine] == t]]
                    for i in np.unique(items[same]).tolist():
                        size, a = int(self.size[i]), int(places[0])
                        mark = np.zeros(int(places[-1]) - a + size, bool)
                        for y in at[same][items[same] == i].tolist():
                            mark[places - a - y + size - 1] = True
                        start = np.flatnonzero(mark) + a - size + 1
                        add(t, i, start)
            lo, n, starts, text = lo[~hot], n[~hot], starts[~hot], text[~hot]
            for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
                m = n[part]
                which = np.repeat(lo[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                add(np.repeat(text[part], m), items[which], np.repeat(starts[part], m) - at[which])
        pair, start = np.divmod(np.unique(np.concatenate(found)), width)
        return pair // n_items, pair % n_items, start - len(self.flat)

    def equal_tokens(self, h: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Equal tokens of every diagonal (sorted by text, item and start) inside its text."""
        out = np.zeros(len(text), np.int64)
        group = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]))))
        sparse = np.ones(len(text), bool)
        for a, b in zip(group.tolist(), np.append(group[1:], len(text)).tolist()):
            size, lo, hi = int(self.size[item[a]]), int(start[a]), int(start[b - 1]) + 1
            if (b - a) * size > PAIRS and hi - lo <= 4 * (b - a):
                # neighbouring diagonals: one token of the item against all of them at a time
                left, right = int(first[text[a]]), int(first[text[a] + 1])
                total = np.zeros(hi - lo, np.int32)
                for j, token in enumerate(self.items[item[a]]):
                    x, y = max(left, lo + j), min(right, hi + j)
                    if x < y:
                        total[x - j - lo : y - j - lo] += h[x:y] == token
                out[a:b] = total[start[a:b] - lo]
                sparse[a:b] = False
        rest = np.flatnonzero(sparse)
        for part in np.split(rest, np.flatnonzero(np.diff(np.cumsum(self.size[item[rest]]) // PAIRS)) + 1):
            if not len(part):
                continue
            n = self.size[item[part]]
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            at = np.repeat(start[part], n) + place
            same = (at >= np.repeat(first[text[part]], n)) & (at < np.repeat(first[text[part] + 1], n))
            same &= h[np.clip(at, 0, len(h) - 1)] == self.flat[np.repeat(self.first[item[part]], n) + place]
            out[part] = np.add.reduceat(same.astype(np.int64), begin)
        return out

    def hits(self, h: np.ndarray, first: np.ndarray, w=None):
        """Verified (text, item, token start, token end, equal tokens) of one slice, one row for a text and item.

        ``w`` has the words behind the hashes ``h``: tokens of equal hash are then compared."""
        text, item, start = self.meetings(h, first)
        if not len(text):
            return
        count = self.equal_tokens(h, first, text, item, start)
        ok = np.flatnonzero(count >= self.least[item])
        ok = ok[np.lexsort((start[ok], -count[ok], item[ok], text[ok]))]
        now, best = None, None
        for t, k, d, n in zip(text[ok].tolist(), item[ok].tolist(), start[ok].tolist(), count[ok].tolist()):
            if (t, k) != now:
                if best:
                    yield (*now, *best[1:])
                now, best = (t, k), None
            # best: its diagonal, start, end and equal tokens; a diagonal cannot give more equal tokens than it has
            if best and (n < best[3] or n == best[3] and d > best[0]):
                continue
            tokens_ = self.items[k]
            left, right = int(first[t]), int(first[t + 1])
            a, b = max(0, left - d), min(len(tokens_), right - d)
            same = tokens_[a:b] == h[a + d : b + d]
            if w is not None:
                for x in np.flatnonzero(same).tolist():
                    y = a + d + x
                    same[x] = w.buf[w.starts[y] : w.ends[y]].tobytes() == self.words[k][a + x]
            length, s, e = best_run(same, self.match)
            if length < needed(len(tokens_), self.share):
                continue
            found = (d, s + a + d - left, e + a + d - left, int(same[s:e].sum()))
            if best is None or (found[3], -d) > (best[3], -best[0]):
                best = found
        if best:
            yield (*now, *best[1:])


def blocks(bench: DataFrame, id_col: str, masks=MASKS, block_windows: int = BLOCK_WINDOWS, share: float = SHARE, match: float = MATCH):
    """Test items in blocks of bounded size, read one partition of ids at a time."""
    rows = bench.select(F.col(id_col).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total * (len(masks) + 1) // (2 * block_windows)))  # a window needs two characters at least
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for p in range(parts):
        got = keyed.where(F.col("part") == p).orderBy("item_id", "text").toPandas()
        if len(got):
            w = tokens(pa.array(got["text"].tolist(), pa.string()))
            items = [w.hash[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
            said = spelled(w)
            told = [said[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
            yield Block([None if x != x else int(x) for x in got["item_id"].tolist()], items, masks, share, match, told)


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "item_id", masks=MASKS, share: float = SHARE, match: float = MATCH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row for each text and item that share a passage: doc_id, item_id, token_start, token_end (in the text's tokens), n_equal, n_item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, token_start long, token_end long, n_equal long, n_item long"
    out = None
    for block in blocks(bench, id_col, masks, block_windows, share, match):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            block = held.value
            for rows, _, _ in slices(batches):
                w = tokens(rows.column("text"))
                got = list(block.hits(w.hash, w.first, w))
                if got:
                    at = pa.array([x[0] for x in got])
                    cols = [rows.column("doc_id").take(at), pa.array([block.ids[x[1]] for x in got], pa.int64()), *(pa.array([x[k] for x in got], pa.int64()) for k in (2, 3, 4)), pa.array([len(block.items[x[1]]) for x in got], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "token_start", "token_end", "n_equal", "n_item"])

        part = texts(docs).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, bench: DataFrame, id_col: str = "item_id", masks=MASKS, share: float = SHARE, match: float = MATCH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, all columns unchanged. Each block filters in place: no join, no shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    for block in blocks(bench, id_col, masks, block_windows, share, match):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            block = held.value
            for rows, _, _ in slices(batches):
                w = tokens(rows.column("text"))
                clean = np.ones(rows.num_rows, bool)
                clean[[x[0] for x in block.hits(w.hash, w.first, w)]] = False
                yield rows.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
