"""Removal of repeated word windows with suffix automata.

A window is ``length`` consecutive words of one text. A word goes if a window
that covers it also starts earlier: in a text with a smaller doc_id, or earlier
in the same text; windows are judged on the input. Segments of possible repeats
are routed to reference shards (see :mod:`.repeats`), each the size of one
task's memory; a shard's suffix automaton is built and read where its segments
are, since an automaton of the whole corpus has no size bound and cannot be
broadcast. Segments stream through in the order of their first occurrence: the
matching statistics of a segment against all earlier ones and its own earlier
part give the windows seen before, while the segment is added.

A reference of bounded size is another matter: :func:`against` broadcasts the
automata of its shards one after the other and streams the documents past each.

Null and empty texts have no words. Very long texts are judged whole; a text of
one repeated word is one segment. Ties: of equal windows the one that starts
first stays. Texts of fewer words than a window: whole.
Equal texts: all words of every copy but the first go, if they fill a window.
Repeated rows: one of them counts as first. Texts that differ but share a
doc_id stand in a fixed order; null doc_ids come last. Empty table: empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, slices, texts
from .repeats import Plan, flags_to_runs, normal, spans, with_text

LENGTH, GRAM = 20, 5


class Automaton:
    """Suffix automaton of several sequences; equal hashable symbols are equal."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def _clone(self, p: int, c, q: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c) -> int:
        """The state of the stretch at ``last`` and one more symbol."""
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:  # it is known
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def statistics(self, sequence) -> list[int]:
        """For each place, the length of the longest stretch ending there that the automaton holds."""
        nxt, link, length = self.next, self.link, self.len
        state, have, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            q = nxt[state].get(c)
            if q is None:
                have = 0
            else:
                state, have = q, have + 1
            out.append(have)
        return out


    def read(self, sequence) -> list[int]:
        """For each place, the length of the longest stretch ending there that the automaton or an earlier
        place of the sequence holds; the sequence is part of the automaton afterwards."""
        nxt, link, length = self.next, self.link, self.len
        state, have, last, out = 0, 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            q = nxt[state].get(c)
            if q is None:
                have = 0
            else:
                state, have = q, have + 1
            out.append(have)
            last = self._extend(last, c)
            while state and have <= length[link[state]]:  # the state has been split
                state = link[state]
        return out


def match(data: list[bytes], n_occ: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Runs of windows of each segment that an earlier segment holds, or the segment itself further ahead."""
    known = Automaton()
    return [flags_to_runs(np.array(known.read(x.split(b" "))[length - 1 :]) >= length) for x in data]


PLAN = Plan(LENGTH, GRAM, True, match, first_stays=True)


def _whole(sym) -> list[str]:
    out = []
    for a, b in zip(sym.first[:-1].tolist(), sym.first[1:].tolist()):
        out.append(hashlib.sha256(sym.buf[sym.starts[a] : sym.ends[b - 1]].tobytes() if b > a else b"").hexdigest())
    return out


def _apply(batches):
    for rows, buf, off in slices(batches):
        clean, starts, ends, first = normal(buf, off)
        out = []
        for k, spans_ in enumerate(rows.column("spans").to_pylist()):
            a, b = int(first[k]), int(first[k + 1])
            d = np.zeros(b - a + 1, np.int32)
            np.add.at(d, [x["start"] for x in spans_], 1)
            np.subtract.at(d, [x["stop"] for x in spans_], 1)
            gone = np.cumsum(d[:-1]) > 0
            kept = b" ".join(clean[starts[a + s] : ends[a + e - 1]].tobytes() for s, e in flags_to_runs(~gone))
            out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([rows.column("nid"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["nid", "n_removed", "kept"])


def dedup(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, nodes, found = spans(docs, plan, _whole)
    told = with_text(docs, nodes, found).mapInArrow(_apply, "nid long, n_removed long, kept string")
    by_node = nodes.select("d", "nid", "owner").join(told.hint("merge"), "nid", "left").drop("nid")
    same = rows.groupBy("doc_id", "d").agg(F.count(F.lit(1)).alias("k"), F.first("n_units").alias("n_units"), F.first("whole").alias("whole"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).join(by_node, "d")
    later = ~(F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("copy") == 1)) & (F.col("n_units") >= plan.length)
    empty = hashlib.sha256(b"").hexdigest()
    return each.select(
        "doc_id",
        F.col("n_units").alias("n_words"),
        F.when(later, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(later, F.lit(empty)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )


#: Bytes of reference text in one automaton; it takes some 100 times as much memory.
REFERENCE_BYTES = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPANS = "array<struct<start:int,stop:int>>"


def against(docs: DataFrame, reference: DataFrame, length: int = LENGTH, shard_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans of every row of ``docs``: words go that lie in a
    stretch of at least ``length`` words that a text of ``reference`` holds.

    The reference is cut into shards of about ``shard_bytes`` (one longer text is a
    shard of its own); the driver builds one automaton after the other and
    broadcasts it, and the texts stream past all of them in one stage. So it is for
    references of a size that so many passes can afford, such as a benchmark."""
    spark = docs.sparkSession
    ref = reference.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    shards = max(1, -(-(ref.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    out = texts(docs).withColumn("spans", F.array().cast(_SPANS))
    for k in range(shards):
        known = Automaton()
        for r in ref.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).toLocalIterator():
            known.add(_WORD.findall(r["text"].encode()))
        held = spark.sparkContext.broadcast(known)

        def past(batches, held=held):
            for rows in batches:
                found = []
                for text, old in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist()):
                    far = held.value.statistics(_WORD.findall(text.encode()))
                    ends = [e for e, n in enumerate(far) if n >= length and (e + 1 == len(far) or far[e + 1] <= n)]
                    found.append(old + [{"start": e - far[e] + 1, "stop": e + 1} for e in ends])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(found, rows.schema.field("spans").type)], names=["doc_id", "text", "spans"])

        out = out.mapInArrow(past, f"doc_id long, text string, spans {_SPANS}")

    def finish(batches):
        for rows in batches:
            told = []
            for text, spans_ in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist()):
                w = _WORD.findall(text.encode())
                gone = covered(np.array([x["start"] for x in spans_], np.int64), np.array([x["stop"] for x in spans_], np.int64), len(w))
                kept = b" ".join(x for x, g in zip(w, gone.tolist()) if not g)
                told.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in flags_to_runs(gone)]))
            kinds = (pa.int64(), pa.int64(), pa.string(), rows.schema.field("spans").type)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([x[j] for x in told], t) for j, t in enumerate(kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return out.mapInArrow(finish, f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {_SPANS}")
