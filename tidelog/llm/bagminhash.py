"""Near duplicates by weighted Jaccard similarity of word 5-shingles, with BagMinHash.

A text is a multiset of shingles. Its weight axis is cut into dyadic shells
(0,1], (1,2], (2,4], ...; every shingle has in every shell a Poisson process
whose points fall on a register and a weight level drawn from the hierarchy's
halvings, and a point counts where its level is within the shingle's weight.
The earliest point on each register is the signature: two texts agree on a
register with probability equal to their weighted Jaccard similarity. Points
are made in rising time, and a shingle stops once it cannot lower any register.

Signatures are cut into bands. Equal texts are one node beforehand. In each
bucket every node is verified against the bucket's first (a star, linear in the
bucket). Where a bucket still holds several classes, the nodes outside its
largest class are compared with all others of the bucket, in blocks of bounded
size, by signature first and by exact multisets after; pairs inside the largest
class are never made. So no bucket is capped, and a stranger among a million
copies costs a million comparisons, not their square.

Shingles are told apart by 64-bit hashes of their words' 64-bit hashes: a pair
of texts of 10,000 shingles each is one shingle off with probability 5e-12.
Texts of one to four words are one shingle. Texts without words equal only
themselves. Null text: empty. Very long texts are signed whole; a task holds one
with some 100 times its bytes. Ties: pairs of exactly the least similarity
count; a class is named by its smallest doc_id (null if no member has one), and
of rows with that id the one with the smallest text digest stays. Repeated rows
share a class. Empty table: empty result. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, drop_cut, grams, mix, partitions, slices, texts, words
from .graph import components

SHINGLE, REGISTERS, ROWS, SIMILARITY = 5, 96, 4, 0.8
#: Register agreement below which a pair is not looked at again: 6.1 standard deviations under SIMILARITY,
#: so that it misses far fewer pairs than the bands do.
ESTIMATE = 0.55
BLOCK = 512


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every shingle, repeats included."""
    g = grams(w.hash, n)
    at = np.flatnonzero(w.doc[n - 1 :] == w.doc[: len(w.doc) - n + 1]) if len(g) else np.zeros(0, np.int64)
    doc, key = w.doc[at], g[at]
    count = w.counts
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = count[short] > k
            h[more] = h[more] * np.uint64(0x9FB21C651E98DF25) + w.hash[w.first[short[more]] + k]
        doc, key = np.concatenate((doc, short)), np.concatenate((key, mix(h + count[short].astype(np.uint64))))
    return doc, key


def signatures(doc: np.ndarray, key: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """An (n_docs, m) array of register identities; rows of documents without shingles are zero."""
    _, at, weight = np.unique(mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    doc, key = doc[at], key[at]
    top = np.ceil(np.log2(weight)).astype(np.int64) + 1  # shells that reach into the weight
    row = np.repeat(np.arange(len(doc)), top)
    shell = np.arange(len(row)) - np.repeat(np.cumsum(top) - top, top)
    doc, state, weight = doc[row], mix(key[row] + (shell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)), weight[row]
    low = np.where(shell == 0, 0, 1 << np.maximum(shell - 1, 0))
    width = np.where(shell == 0, 1, low)
    when = np.zeros(len(doc))
    soonest, who = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    j = 0
    while len(doc):
        j += 1
        r = mix(state + np.uint64(j * 0xE7037ED1A0B428DB & (1 << 64) - 1))
        when = when - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
        limit = soonest.reshape(n_docs, m).max(axis=1)
        live = when < limit[doc]
        doc, state, weight, low, width, when, r = doc[live], state[live], weight[live], low[live], width[live], when[live], r[live]
        q = mix(r ^ np.uint64(0x8EBC6AF09C88C6E3))
        level = low + 1 + ((q & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
        slot = doc * m + ((q >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        inside = np.flatnonzero(level <= weight)
        slot_in, when_in = slot[inside], when[inside]
        np.minimum.at(soonest, slot_in, when_in)
        won = soonest[slot_in] == when_in
        who[slot_in[won]] = r[inside][won]
    return who.reshape(n_docs, m)


def _sign(batches):
    for rows, buf, off in slices(batches):
        n = len(off) - 1
        sig = signatures(*shingles(words(buf, off)), n).astype(np.uint32).view(np.int32)
        flat = pa.array(sig.ravel(), pa.int32())
        yield pa.RecordBatch.from_arrays([rows.column("d"), rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * REGISTERS), flat)], names=["d", "doc_id", "sig"])


def _sets(batches):
    """Sorted shingle sets, the copies of a repeated shingle told apart, so that a set intersection is the multiset one."""
    for rows, buf, off in slices(batches):
        doc, key = shingles(words(buf, off))
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        start = np.flatnonzero(new)
        copy = np.arange(len(doc)) - np.repeat(start, np.diff(np.append(start, len(doc))))
        key = mix(key + copy.astype(np.uint64) * np.uint64(0x589965CC75374CC3))
        cuts = np.searchsorted(doc, np.arange(len(off)))
        yield pa.RecordBatch.from_arrays([rows.column("nid"), pa.array([np.sort(key[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["nid", "items"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate((a, b))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same) if len(both) else 0.0


def _verify(least: float):
    def run(batches):
        for batch in batches:
            one, two = batch.column("one").to_pylist(), batch.column("two").to_pylist()
            ok = []
            for x, y in zip(one, two):
                small, large = sorted((len(x), len(y)))
                ok.append(small >= least * large and similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def nodes(docs: DataFrame) -> DataFrame:
    """One row for each different text: d (its digest), owner (smallest doc_id), n_owner (rows with that id), sig, nid."""
    base = texts(docs).withColumn("d", F.unhex(F.md5("text")))
    signed = base.mapInArrow(_sign, "d binary, doc_id long, sig array<int>")
    ids = signed.groupBy("d", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
    one = ids.groupBy("d").agg(F.min_by(F.struct("doc_id", "n"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("o"), F.first("sig").alias("sig"))
    return cut(one.select(F.monotonically_increasing_id().alias("nid"), "d", F.col("o.doc_id").alias("owner"), F.col("o.n").alias("n_owner"), "sig"))


def _bands(rows: int):
    def key(i):
        return F.xxhash64(F.lit(i), *(F.get("sig", F.lit(i * rows + k)) for k in range(rows)))

    return F.posexplode(F.array(*(key(i) for i in range(REGISTERS // rows)))).alias("band", "bucket")


def _item_sets(docs: DataFrame, all_nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the wanted nodes, from their owners' rows."""
    who = all_nodes.join(wanted, "nid").select("nid", "d", F.col("owner").alias("doc_id"), "n_owner")
    base = texts(docs).withColumn("d", F.unhex(F.md5("text")))
    on = (base["d"] == who["d"]) & base["doc_id"].eqNullSafe(who["doc_id"])
    sets = base.join(who, on).select("nid", "n_owner", "text").mapInArrow(_sets, "nid long, items binary")
    repeated = all_nodes.where("n_owner > 1").limit(1).count()
    return cut(sets.dropDuplicates(["nid"]) if repeated else sets)


def _compare(rows: pd.DataFrame, least: float, by_sig: bool, band_rows: int = ROWS):
    """Within each task: nodes of side 0 (outside the bucket's largest class) against those of side 1. Yields
    rows with a partner of another label that looks alike (by_sig), or verified links that join labels.
    A pair that shares several bands counts in the first of them, and two nodes that both lie outside
    the largest class count where the smaller number is on side 0."""
    for (band, bucket, i, j), g in rows.groupby(["band", "bucket", "i", "j"], sort=False):
        label, nid, side, small = (g[c].to_numpy() for c in ("label", "nid", "side", "small"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if by_sig:
            sig = np.stack(g["data"].to_numpy())
            hit = np.zeros(len(g), bool)
            for x in left.tolist():
                mine = right[(label[right] != label[x]) & (~small[right] | (nid[right] > nid[x]))]
                if not len(mine):
                    continue
                same = sig[mine] == sig[x]
                ok = same.sum(axis=1) >= least * sig.shape[1]
                ok &= ~same[:, : band * band_rows].reshape(len(mine), -1, band_rows).all(axis=2).any(axis=1)
                if ok.any():
                    hit[x] = True
                    hit[mine[ok]] = True
            for x in np.flatnonzero(hit).tolist():
                yield band, bucket, i, j, nid[x], side[x], small[x], label[x]
            continue
        sets = [np.frombuffer(x, np.uint64) for x in g["data"]]
        head = {x: x for x in label.tolist()}

        def find(x):
            while head[x] != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        for x in left.tolist():
            for y in right.tolist():
                if small[y] and nid[y] <= nid[x] or find(label[x]) == find(label[y]):
                    continue
                low, high = sorted((len(sets[x]), len(sets[y])))
                if low >= least * high and similarity(sets[x], sets[y]) >= least:
                    head[find(label[x])] = find(label[y])
                    yield nid[x], nid[y]


def links(docs: DataFrame, all_nodes: DataFrame, rows: int = ROWS, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between nodes whose components are the classes."""
    spark = docs.sparkSession
    parts = partitions(spark)
    band = all_nodes.where(F.array_max("sig") != F.array_min("sig")).select("nid", _bands(rows))
    bucket = ["band", "bucket"]
    heads = cut(band.groupBy(*bucket).agg(F.min("nid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(band.join(heads, bucket))
    pairs = cut(members.where("nid <> head").select(F.col("head").alias("a"), F.col("nid").alias("b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    sets = _item_sets(docs, all_nodes, wanted)

    def joined(p):
        two = p.join(sets.select(F.col("nid").alias("b"), F.col("items").alias("two")), "b")
        return two.join(sets.select(F.col("nid").alias("a"), F.col("items").alias("one")), "a").select("a", "b", "one", "two")

    star = cut(joined(pairs).mapInArrow(_verify(least), "a long, b long"))
    labels = components(star)
    known = members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select(*bucket, "nid", "n", F.coalesce("label", "nid").alias("label"))
    # of each bucket with several labels: how many nodes its largest label has
    sizes = known.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("k"))
    open_ = cut(sizes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("k", "label")).alias("top")).where("labels > 1").select(*bucket, F.col("top.label").alias("big"), F.col("top.k").alias("k")))
    rest = known.join(open_, bucket).withColumn("small", F.col("label") != F.col("big"))
    n_all, n_small = F.ceil(F.col("n") / block).cast("int"), F.ceil((F.col("n") - F.col("k")) / block).cast("int")
    mine = rest.withColumn("in_all", F.pmod(F.xxhash64("nid"), n_all).cast("int")).withColumn("in_small", F.pmod(F.xxhash64("nid"), n_small).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = mine.where("small").select(*bucket, F.col("in_small").alias("i"), upto(n_all).alias("j"), "nid", F.lit(0).alias("side"), "small", "label")
    two = mine.select(*bucket, upto(n_small).alias("i"), F.col("in_all").alias("j"), "nid", F.lit(1).alias("side"), "small", "label")
    dealt = cut(one.unionByName(two))
    kinds = "band int, bucket long, i int, j int, nid long, side int, small boolean, label long"

    def task(n_rows: int, row_bytes: int):
        """Groups dealt to tasks of about 8 MB."""
        return F.pmod(F.xxhash64(*bucket, "i", "j"), F.lit(max(4 * parts, n_rows * row_bytes >> 23))).alias("task")

    def look(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_compare(g, ESTIMATE * least / SIMILARITY, True, rows)), columns=[*bucket, "i", "j", "nid", "side", "small", "label"])

    def prove(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_compare(g, least, False)), columns=["a", "b"])

    signed = dealt.join(all_nodes.select("nid", F.col("sig").alias("data")), "nid")
    alike = cut(signed.select("*", task(dealt.count(), 4 * REGISTERS)).groupBy("task").applyInPandas(look, kinds))
    size = sets.agg(F.coalesce(F.avg(F.length("items")), F.lit(0))).first()[0]
    listed = alike.join(sets.select("nid", F.col("items").alias("data")), "nid")
    proven = listed.select("*", task(alike.count(), int(size))).groupBy("task").applyInPandas(prove, "a long, b long")
    out = cut(star.unionByName(proven))
    for x in (heads, members, pairs, sets, star, open_, dealt, alike):
        drop_cut(x)
    return out


def classes(docs: DataFrame, rows: int = ROWS, least: float = SIMILARITY) -> DataFrame:
    """One row for each different text: d, class_id (smallest doc_id of its class), class_d (digest of the text that stays), owner, n_owner."""
    all_nodes = nodes(docs)
    labels = components(links(docs, all_nodes, rows, least))
    who = all_nodes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("d", "owner", "n_owner", F.coalesce("label", "nid").alias("label"))
    first = who.groupBy("label").agg(F.min(F.struct(F.col("owner").isNull().alias("none"), "owner", "d")).alias("f"), F.sum("n_owner").alias("n"))
    return cut(who.join(first, "label").select("d", F.col("f.owner").alias("class_id"), F.col("f.d").alias("class_d"), "owner", "n_owner"))


def near_duplicates(docs: DataFrame, rows: int = ROWS, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every row of ``docs``."""
    base = texts(docs).select("doc_id", F.unhex(F.md5("text")).alias("d"))
    return base.join(classes(docs, rows, least).select("d", "class_id"), "d").select("doc_id", "class_id")


def keep_one(docs: DataFrame, rows: int = ROWS, least: float = SIMILARITY) -> DataFrame:
    """Of each class the row with the smallest doc_id, all columns unchanged."""
    found = classes(docs, rows, least)
    stay = found.where("d = class_d").select("d", F.col("owner").alias("doc_id"), "n_owner")
    # the row travels as one struct, so its columns cannot clash with those of the join
    whole = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("d"), F.col("doc_id").cast("long").alias("doc_id"))
    out = whole.join(stay, (whole["d"] == stay["d"]) & whole["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    if found.where("n_owner > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "d"])
    return out.select("row.*")
