"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models, of toxic and of ordinary labelled texts, predict each byte of a
lower-cased word (and its end) from up to five bytes before it. Both back off to
one shared Kneser-Ney model, which goes through all lower orders: the count of a
gram of k bytes is the number of different grams of k + 1 bytes (of either
class) that end with it, and what is discounted goes to the next lower order,
down to single bytes. So an expression that a class has hardly seen costs it
little more than the shared share, and the difference of the two log-likelihoods
comes from what one class has seen and the other not.

Grams are counted in the cluster over every training text, and no gram is left
out for its number or a small ratio. A table of log-ratios of at most
``MOST_KEYS`` grams and contexts (12 bytes each) is broadcast whole. A larger one
stays distributed: texts are dealt into chunks of about ``CHUNK_BYTES``, each
chunk's distinct grams and contexts meet the table in a shuffle, and a chunk is
scored with the rows that came back; so no task holds more of the model than its
chunk asks for. Both ways give the same scores. A context's backoff serves only
grams that no count has.

A text's features are the length-normalised log-likelihood difference (also
returned by itself, as ``difference``), the largest one of a word, and the
largest length-normalised one of a word. A logistic curve over them is fitted on
training rows that the counts have not seen, at most ``FIT_ROWS`` of them, chosen
by hash; then the counts are taken again over all training rows.

Only rows whose crc32(doc_id) mod 5 is not 0 are learned from: 1 to 3 for the
counts that the curve is fitted to, 4 for the curve, all four for the counts
that score. Scores use the text alone. Null text: empty. Empty texts get the
curve's value at zero evidence. Very long texts are scored whole, one at a time.
No labels of one class: every score is the other class's share. Ties: a score of
one half counts as toxic. Null doc_id: scored, not held out, never learned from.
Repeated rows are scored alike; a row with several labels counts once for each.
Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffer_of, cut, drop_cut, free_shuffles, slices, texts, words

ORDER, DISCOUNT = 6, 0.75
CHUNK_BYTES = 16 << 20
MOST_KEYS = 8_000_000
FIT_ROWS = 20_000
#: Set in the keys of contexts, which share one table with the grams (48 bits).
CONTEXT = 1 << 60


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def events(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, gram) for every byte of the words and for their ends. A gram
    holds the byte lowest and up to five bytes before it above, a space for the word's edge."""
    length = ends - starts + 2
    total = int(length.sum())
    word = np.repeat(np.arange(len(starts)), length)
    place = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    byte = np.full(total, 0x20, np.uint64)
    inner = (place > 0) & (place < length[word] - 1)
    byte[inner] = buf[(starts[word] + place - 1)[inner]]
    gram = byte.copy()
    for j in range(1, ORDER):
        ok = np.flatnonzero(place >= j)
        gram[ok] |= byte[ok - j] << np.uint64(8 * j)
    keep = place > 0
    return word[keep], gram[keep]


def lowered(arr):
    buf, off = buffer_of(pc.utf8_lower(arr))
    return buf, off, words(buf, off)


def _count(batches):
    for rows, _, _ in slices(batches):
        toxic = rows.column("toxic").to_numpy(zero_copy_only=False)
        buf, off, w = lowered(rows.column("text"))
        for c in (0, 1):
            number, one = w.classes
            n = np.bincount(number[toxic[w.doc] == c], minlength=len(one))
            mine = np.flatnonzero(n)
            word, gram = events(buf, w.starts[one[mine]], w.ends[one[mine]])
            g, inverse = np.unique(gram, return_inverse=True)
            total = np.bincount(inverse, weights=n[mine][word], minlength=len(g)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"g": g.astype(np.int64), "toxic": np.full(len(g), c, np.int32), "n": total})


def shared(counted: DataFrame) -> DataFrame:
    """(low, shared): the backoff model's probability of the last byte of every gram of ORDER - 1 bytes,
    from the different grams ``g`` of ORDER bytes. A context has at most 256 rows in any window."""
    kinds, types = {}, counted.select(F.col("g").alias("low"))
    for k in range(ORDER - 1, 0, -1):
        types = cut(types.groupBy(F.col("low").bitwiseAND((1 << 8 * k) - 1).alias("low")).agg(F.count(F.lit(1)).alias("c")))
        kinds[k] = types
    out = None
    for k in range(1, ORDER):
        w = Window.partitionBy("ctx")
        now = kinds[k].withColumn("ctx", F.shiftright("low", 8)).withColumn("all", F.sum("c").over(w)).withColumn("kinds", F.count(F.lit(1)).over(w))
        if out is None:
            out = now.select("low", (F.col("c") / F.col("all")).alias("shared"))
            continue
        below = out.select(F.col("low").alias("below"), F.col("shared").alias("p"))
        now = now.withColumn("below", F.col("low").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(below, "below")
        out = now.select("low", ((F.col("c") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("all")).alias("shared"))
    out = cut(out)
    for x in kinds.values():
        drop_cut(x)
    return out


def ratios(train: DataFrame) -> DataFrame:
    """(key, ratio) of every gram and context, from training rows (text, toxic); a table of :func:`cut`."""
    one, two = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    counted = cut(train.mapInArrow(_count, "g long, toxic int, n long").groupBy("g").agg(one.alias("t"), two.alias("o")))
    few = counted.agg(*(F.sum(F.when(F.col(c) == k, 1).otherwise(0)).alias(f"{c}{k}") for c in "to" for k in (1, 2))).first()
    d = {c: (few[f"{c}1"] or 0) / max(1, (few[f"{c}1"] or 0) + 2 * (few[f"{c}2"] or 0)) or 0.5 for c in "to"}
    g = counted.withColumn("ctx", F.shiftright("g", 8)).withColumn("low", F.col("g").bitwiseAND((1 << 8 * (ORDER - 1)) - 1))
    ctx = g.groupBy("ctx").agg(*(F.sum(c).alias(f"{c}_n") for c in "to"), *(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"{c}_k") for c in "to"))
    low = shared(counted)
    whole = g.join(ctx, "ctx").join(low, "low")

    def rest(c):
        return F.when(F.col(f"{c}_n") > 0, d[c] * F.col(f"{c}_k") / F.col(f"{c}_n")).otherwise(1.0)

    def prob(c):
        return F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(c) - d[c], F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0) + rest(c) * F.col("shared")

    seen = whole.select(F.col("g").alias("key"), (F.log(prob("t")) - F.log(prob("o"))).cast("float").alias("ratio"))
    unseen = ctx.select((F.col("ctx") + F.lit(CONTEXT)).alias("key"), (F.log(rest("t")) - F.log(rest("o"))).cast("float").alias("ratio"))
    out = cut(seen.unionByName(unseen))
    for x in (counted, low):
        drop_cut(x)
    return out


def _ask(rows: pa.Table) -> pa.Table:
    """The distinct grams and contexts of a chunk."""
    asked = []
    for part, _, _ in slices(rows.to_batches()):
        buf, _, w = lowered(part.column("text"))
        at = w.classes[1]
        asked.append(np.unique(events(buf, w.starts[at], w.ends[at])[1]).astype(np.int64))
    g = np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.int64)
    key = np.concatenate((g, np.unique(g >> 8) + CONTEXT))
    return pa.table({"chunk": pa.array(np.full(len(key), rows.column("chunk")[0].as_py()), pa.int64()), "key": pa.array(key, pa.int64())})


def look_up(rows: DataFrame, model: DataFrame, run, schema: str, chunk_bytes: int = CHUNK_BYTES, most_keys: int = MOST_KEYS) -> DataFrame:
    """``run(batch, x)`` of every slice of ``rows``, x being the features of its texts under the table of :func:`ratios`."""
    if model.limit(most_keys + 1).count() <= most_keys:
        whole = model.toArrow()
        held = rows.sparkSession.sparkContext.broadcast(Model.of(whole.column("key").to_numpy(), whole.column("ratio").to_numpy()))

        def every(batches):
            for r, _, _ in slices(batches):
                yield run(r, held.value.features(r.column("text")))

        return rows.mapInArrow(every, schema)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    # one exchange of the texts serves both the question and the scoring
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition("chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask, "chunk long, key long")
    answers = asked.join(model.hint("merge"), "key").select(F.col("chunk").alias("of"), "key", "ratio")

    def judge(texts: pa.Table, known: pa.Table) -> pa.Table:
        model = Model.of(known.column("key").to_numpy(), known.column("ratio").to_numpy())
        return pa.Table.from_batches([run(r, model.features(r.column("text"))) for r, _, _ in slices(texts.to_batches())])

    return dealt.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(judge, schema)


class Model:
    def __init__(self, grams, contexts):
        self.grams, self.contexts = grams, contexts

    @classmethod
    def of(cls, keys, values):
        """From keys and ratios in any order."""
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        k = np.searchsorted(keys, CONTEXT)
        return cls((keys[:k], values[:k]), (keys[k:] - CONTEXT, values[k:]))

    @staticmethod
    def look(table, keys):
        """(found, value) in a sorted table."""
        have, value = table
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        ok = have[at] == keys
        return ok, np.where(ok, value[at], 0)

    def features(self, arr) -> np.ndarray:
        """A row for each text: difference a byte, largest of a word, largest of a word a byte."""
        buf, off, w = lowered(arr)
        n = len(off) - 1
        out = np.zeros((n, 3))
        if not len(w.starts):
            return out
        back, at = w.classes
        word, gram = events(buf, w.starts[at], w.ends[at])
        gram = gram.astype(np.int64)
        g, inverse = np.unique(gram, return_inverse=True)
        ok, value = self.look(self.grams, g)
        ctx_ok, ctx_value = self.look(self.contexts, g >> 8)
        value = np.where(ok, value, ctx_value)[inverse]
        ratio = np.bincount(word, weights=value, minlength=len(at))[back]
        length = (w.ends - w.starts + 1).astype(np.float64)
        total = np.bincount(w.doc, weights=ratio, minlength=n)
        size = np.bincount(w.doc, weights=length, minlength=n)
        some = np.flatnonzero(w.counts)
        first = w.first[some]
        out[:, 0] = total / np.maximum(size, 1)
        out[some, 1] = np.maximum(np.maximum.reduceat(ratio, first), 0)
        out[some, 2] = np.maximum(np.maximum.reduceat(ratio / length, first), 0)
        return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, means, scales) of a logistic curve, by Newton steps."""
    if not len(y):
        return np.zeros(x.shape[1] + 1), np.zeros(x.shape[1]), np.ones(x.shape[1])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, chunk_bytes: int = CHUNK_BYTES, most_keys: int = MOST_KEYS) -> DataFrame:
    """doc_id, held_out, score, predicted and difference of every row."""
    spark = docs.sparkSession
    mine = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(fold("_id") != 0)
    rows = texts(docs).where(fold() != 0)
    # labels grow with the corpus, so they are never broadcast, however few there are
    known = cut(rows.join(mine.hint("merge"), rows["doc_id"] == mine["_id"]).select("doc_id", "toxic", "text", fold().alias("fold")))
    free_shuffles(spark)
    first = ratios(known.where("fold < 4").select("text", "toxic"))

    def measure(r, x):
        return pa.RecordBatch.from_arrays([r.column("toxic"), *(pa.array(x[:, k]) for k in range(3))], names=["toxic", "a", "b", "c"])

    spare = known.where("fold = 4")
    n = spare.count()
    part = spare.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20 if n <= fit_rows else (fit_rows << 20) // n))
    got = look_up(part.select("doc_id", "text", "toxic"), first, measure, "toxic int, a double, b double, c double", chunk_bytes, most_keys).collect()
    got = np.array([tuple(r) for r in got], float).reshape(-1, 4)
    drop_cut(first)
    model = ratios(known.select("text", "toxic"))
    drop_cut(known)
    free_shuffles(spark)
    weights, mean, scale = fit(got[:, 1:], got[:, 0])

    def judge(r, x):
        p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ weights[:-1] + weights[-1], -30, 30)))
        return pa.RecordBatch.from_arrays([r.column("doc_id"), r.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x[:, 0])], names=["doc_id", "held_out", "score", "predicted", "difference"])

    every = texts(docs).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return look_up(every, model, judge, "doc_id long, held_out boolean, score double, predicted int, difference double", chunk_bytes, most_keys)
