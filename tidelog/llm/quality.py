"""Quality rules as a short-circuit cascade.

Each rule says which texts it rejects. Its cost (seconds a text) and its
rejection rate are measured on a hashed sample inside the executors; rules then
run in descending rejection per cost, each only on what the earlier ones left.
A verdict is a conjunction, so the order changes the time and never the result.

Lines and words are told apart by their bytes; hashes only bring equal ones together.

Null text: empty. Empty text: no words, rejected by ``few_words``. Very long
texts are measured whole, one at a time, in memory of some 60 times their
bytes. Ties: a text that several rules reject is named after the first in the
measured order, and kept or not all the same; rules of equal worth keep the
order given. Repeated rows are judged one by one and alike. An empty table
gives an empty result. Columns other than doc_id and text are not read and
cannot clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _CONT, _WS, bound_batches, exact, per_doc, prefix_hash, slices, span_hash, texts, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True


class Measures:
    """Lazily computed measures of the texts in one slice; a rule pays for what it is first to use."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off

    def part(self, rows: np.ndarray) -> Measures:
        """The measures of some of the texts: what is known of them goes along, their bytes are put together."""
        out = Measures(*take(self.buf, self.off, rows))
        for name in ("n_words", "word_chars", "n_symbols", "n_bangs", "upper_lower", "lines", "n_repeat_words"):
            if name in self.__dict__:
                known = self.__dict__[name]
                out.__dict__[name] = tuple(x[rows] for x in known) if isinstance(known, tuple) else known[rows]
        return out

    @cached_property
    def words(self):
        return words(self.buf, self.off)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        return per_doc(~(_WS | _CONT)[self.buf], self.off)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return per_doc(_SYMBOL[self.buf], self.off)

    @cached_property
    def n_bangs(self) -> np.ndarray:
        return per_doc(_BANG[self.buf], self.off)

    @cached_property
    def upper_lower(self) -> tuple[np.ndarray, np.ndarray]:
        return per_doc(_UPPER[self.buf], self.off), per_doc(_LOWER[self.buf], self.off)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, of them those equal to an earlier one) by document."""
        buf, off, n = self.buf, self.off, len(self.off) - 1
        breaks = np.flatnonzero(buf == 0x0A)
        starts = np.concatenate((off[:-1], breaks + 1))
        ends = np.concatenate((off[1:], breaks))
        starts.sort()
        ends.sort()
        doc = np.searchsorted(off, np.minimum(starts, max(len(buf) - 1, 0)), "right") - 1
        word_sum = np.concatenate(([0], np.cumsum(~_WS[buf])))
        has = word_sum[ends] > word_sum[starts]
        starts, ends, doc = starts[has], ends[has], doc[has]
        line, known = exact(buf, starts, ends, span_hash(prefix_hash(buf), starts, ends))
        pairs = np.unique(doc * max(len(known), 1) + line)
        distinct = np.bincount(pairs // max(len(known), 1), minlength=n)
        count = np.bincount(doc, minlength=n)
        return count, count - distinct

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w, n = self.words, len(self.off) - 1
        at = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        if not len(at):
            return np.zeros(n, np.int64)
        number, known = w.classes
        one, two, three = number[at], number[at + 1], number[at + 2]
        bits = max(len(known) - 1, 1).bit_length()
        if 3 * bits < 64:
            key = (one << 2 * bits) | (two << bits) | three
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
        else:
            order = np.lexsort((three, two, one))
            same = np.ones(len(at) - 1, bool)
            for x in (one, two, three):
                same &= x[order][1:] == x[order][:-1]
        # the order is stable, so windows of one document stand together among equal ones
        same &= w.doc[at[order]][1:] == w.doc[at[order]][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(number), bool)
        s = at[twice]
        hit[s] = hit[s + 1] = hit[s + 2] = True
        return np.bincount(w.doc[hit], minlength=n)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


def _shouting(m: Measures) -> np.ndarray:
    upper, lower = m.upper_lower
    return (upper > 2 * lower) & (upper + lower >= 50)


#: The base rules come first here; the cascade finds its own order.
BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repetition", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
EXTRA_RULES = (
    Rule("symbols", lambda m: 4 * m.n_symbols > m.n_words),
    Rule("shouting", _shouting),
    Rule("bangs", lambda m: 2 * m.n_bangs > m.n_words),
    Rule("duplicate_lines", lambda m: 2 * m.lines[1] > m.lines[0]),
    Rule("word_length", lambda m: (m.word_chars > 25 * m.n_words) | (m.word_chars < 2 * m.n_words)),
)
#: Texts that costs and selectivities are estimated on, about; the verdicts never depend on it.
SAMPLE_ROWS = 2000


def take(buf: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of the chosen rows, put together."""
    length = np.diff(off)[keep]
    new = np.concatenate(([0], np.cumsum(length)))
    parts = [buf[a:b] for a, b in zip(off[:-1][keep].tolist(), off[1:][keep].tolist())]
    return (np.concatenate(parts) if parts else buf[:0]), new


def plan(docs: DataFrame, rules=EXTRA_RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by measured rejection per cost. Executors time the rules on a hashed
    sample and only sums come to the driver."""
    rules = list(rules)

    def measure(batches):
        spent, gone, seen = np.zeros(len(rules)), np.zeros(len(rules)), 0
        for _, buf, off in slices(batches):
            seen += len(off) - 1
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                gone[k] += int(rule.rejects(Measures(buf, off)).sum())
                spent[k] += time.perf_counter() - began
        if seen:
            yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "spent": spent.tolist(), "gone": gone.tolist(), "seen": [float(seen)] * len(rules)})

    rows = docs.count()
    share = 1 << 20 if rows <= sample_rows else max(1, (sample_rows << 20) // rows)
    sample = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("text")
    found = sample.mapInArrow(measure, "rule long, spent double, gone double, seen double").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("gone").alias("gone"), F.sum("seen").alias("seen")).collect()
    worth = {r["rule"]: (r["gone"] / r["seen"]) / max(r["spent"] / r["seen"], 1e-12) for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0.0), k))]


def cascade(m: Measures, rules, alive: np.ndarray | None = None) -> np.ndarray:
    """Index of the rule that rejected each text, -1 where none did; rows not ``alive`` are passed over (-2).

    Rules see the texts that are left. Measures made before a rule are used again;
    the bytes of what is left are put together anew only once half of them are gone."""
    n = len(m.off) - 1
    verdict = np.full(n, -1 if alive is None else -2, np.int64)
    if alive is not None:
        verdict[alive] = -1
    mine = np.arange(n)  # the rows that m measures
    for k, rule in enumerate(rules):
        rest = np.flatnonzero(verdict[mine] == -1)
        if not len(rest):
            break
        if 2 * len(rest) < len(mine):
            m, mine, rest = m.part(rest), mine[rest], np.arange(len(rest))
        verdict[mine[rest[rule.rejects(m)[rest]]]] = k
    return verdict


def keep_good(docs: DataFrame, rules=BASE_RULES + EXTRA_RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged."""
    bound_batches(docs.sparkSession)
    ordered = plan(docs, rules)
    schema = docs.schema

    def run(batches):
        for rows, buf, off in slices(batches):
            yield rows.filter(pa.array(cascade(Measures(buf, off), ordered) == -1))

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, rules=EXTRA_RULES) -> DataFrame:
    """Base measures of every text and the cascade's verdict."""
    ordered = plan(docs, rules)

    def run(batches):
        for rows, buf, off in slices(batches):
            m = Measures(buf, off)
            columns = [x.astype(np.int64) for x in (m.n_words, m.word_chars, m.n_symbols, m.lines[1], m.n_repeat_words)]
            failed = BASE_RULES[0].rejects(m) | BASE_RULES[1].rejects(m)
            # the base measures are part of the result, so every text has them; the extra rules add only what they need
            by = cascade(m, ordered, ~failed)
            names = [None if k < 0 else ordered[k].name for k in by.tolist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(x) for x in columns), pa.array(failed), pa.array(by == -1), pa.array(names, pa.string())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
