"""Operators on the whole corpus, against brute force."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import bagminhash, common, decontam, graph, mixing, quality, reshard, toxicity
from tidelog.llm.queries import ORACLES, QUERIES

from .conftest import SCHEMA, prose, table_of
from .test_texts import WORD

# ------------------------------------------------------------ near duplicates


def bag(t, n=5):
    w = WORD.findall(t)
    return Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else Counter()


def brute_classes(rows):
    texts = sorted({r[1] or "" for r in rows})
    head = {t: t for t in texts}

    def find(t):
        while head[t] != t:
            t = head[t]
        return t

    bags = {t: bag(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = bags[a], bags[b]
            inter = sum((x & y).values())
            if inter and inter >= 0.8 * (sum(x.values()) + sum(y.values()) - inter):
                head[find(a)] = find(b)
    name = {}
    for r in rows:
        c = find(r[1] or "")
        if r[0] is not None:
            name[c] = min(name.get(c, r[0]), r[0])
    return sorted(((r[0], name.get(find(r[1] or ""))) for r in rows), key=repr)


def test_classes(docs, rows, empty):
    assert table_of(bagminhash.near_duplicates(docs)) == brute_classes(rows)
    assert bagminhash.near_duplicates(empty).count() == 0 and bagminhash.keep_one(empty).count() == 0


def test_classes_on_the_table(spark, sf):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = table_of(bagminhash.near_duplicates(d))
    assert got == brute_classes([(r.doc_id, r.text) for r in d.collect()])


def test_chains_and_blocks(spark):
    """A chain of texts, each near only the next ones: one class, through residual buckets of several blocks."""
    rng = random.Random(4)
    w = prose(rng, 260).split()
    chain = [" ".join(w[k * 6 : k * 6 + 200]) for k in range(10)]
    rows = [(k, t, "", "", 0) for k, t in enumerate(chain)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_classes(rows)
    assert table_of(bagminhash.near_duplicates(df)) == want
    nodes = bagminhash.nodes(df)
    labels = graph.components(bagminhash.links(df, nodes, block=3))
    assert labels.select("label").distinct().count() == len({c for _, c in want})


def test_nodes_without_a_partner_in_their_block():
    """A node outside the largest class may find nothing to compare with on the other side of its block."""
    sig = np.arange(bagminhash.REGISTERS)
    row = {"band": 0, "bucket": 1, "i": 0, "j": 0, "side": 0, "small": True, "label": 5, "nid": 7, "data": sig}
    alone = pd.DataFrame([row, row | {"side": 1}])
    assert list(bagminhash._compare(alone, 0.5, True)) == []
    two = pd.DataFrame([row, row | {"side": 1, "small": False, "label": 1, "nid": 2}])
    assert [r[4] for r in bagminhash._compare(two, 0.5, True)] == [7, 2]


def test_keep_one(docs, rows):
    left = bagminhash.keep_one(docs)
    assert left.columns == docs.columns and {r.label for r in left.collect()} == {"clash"}
    classes = dict(brute_classes([r for r in rows if r[0] is not None and r[0] != 17]))
    got = [r.doc_id for r in left.collect() if r.doc_id is not None and r.doc_id != 17]
    assert sorted(got) == sorted(set(classes.values()) - {17})


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(300):
        u = rng.integers(1, 1 << 60, 120, dtype=np.uint64)
        a = rng.integers(0, 9, 120)
        b = np.where(rng.random(120) < 0.8, a, rng.integers(0, 9, 120))
        doc = np.concatenate((np.zeros(a.sum(), int), np.ones(b.sum(), int)))
        s = bagminhash.signatures(doc, np.concatenate((np.repeat(u, a), np.repeat(u, b))), 2)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 4 * np.std(off) / np.sqrt(len(off)) + 1e-3 and np.std(off) < 0.06


def test_estimate_misses_less_than_the_bands():
    m, s = bagminhash.REGISTERS, bagminhash.SIMILARITY
    missed = sum(math.comb(m, k) * s**k * (1 - s) ** (m - k) for k in range(math.ceil(bagminhash.ESTIMATE * m)))
    bands = (1 - s**bagminhash.ROWS) ** (m // bagminhash.ROWS)
    assert missed < 0.01 * bands


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 340)]
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            head[y] = x
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in head}


# ------------------------------------------------------------ mixing


def test_mix_against_sql(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(mixing.MIX_SQL.replace("{docs}", f"'{tmp_path}/d/*.parquet'")).fetchall()
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
    assert table_of(got) == sorted(want, key=repr)


def test_mix_laws(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix(d).collect()
    total, target, taken, largest = Counter(), {}, Counter(), Counter()
    for r in out:
        total[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6 * sum(total.values())
    for s in total:
        assert target[s] <= 2 * total[s] + 1e-9 and abs(taken[s] - target[s]) <= largest[s]
    again = Counter(r.doc_id for r in mixing.mixed(d).collect())
    assert again == Counter({r.doc_id: r.taken // r.size for r in out if r.taken})


def test_mix_edges(spark, empty, docs):
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(none).collect()] == [(0, 0.0)] * 2 and mixing.mixed(none).count() == 0
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and {r.target for r in kept.collect()} == {"clash"}


def test_targets_reshare(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 1, None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, want = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: unit * weight[s] for s in free}
    assert got == pytest.approx(want)


# ------------------------------------------------------------ sharding


def test_reshard(docs, rows, empty):
    got = reshard.assign(docs, reshard.by_source()).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    assert reshard.assign(empty, reshard.by_source()).count() == 0


def test_reshard_balances_and_moves_little(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = reshard.assign(d, reshard.by_source()).collect()
    size, old, moved = Counter(), Counter(), 0
    for r in got:
        size[r.shard] += r.size
        old[r.old_shard] += r.size
        moved += r.size * (r.shard != r.old_shard)
    mean = sum(size.values()) / 16
    assert max(abs(v - mean) for v in size.values()) < 0.005 * mean
    least = sum(max(0, old[k] - mean) for k in range(16))
    assert moved <= 1.01 * least


def test_reshard_spreads_one_repeated_row(spark):
    df = spark.createDataFrame([(1, "same", "s")] * 3200, "doc_id long, text string, source string")
    sizes = Counter(r.shard for r in reshard.assign(df, reshard.by_source()).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 20


def test_min_cost_flow_against_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(n)]
        room = [rng.randint(0, 4) for _ in range(m)]
        if sum(room) < sum(supply):
            with pytest.raises(ValueError):
                reshard.min_cost_flow(supply, room, lambda i, j: 0)
            continue
        cost = {(i, j): rng.randint(0, 5) for i in range(n) for j in range(m)}
        flow = reshard.min_cost_flow(supply, room, lambda i, j: cost[i, j])
        assert all(sum(v for (i, _), v in flow.items() if i == k) == supply[k] for k in range(n))
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]

        def best(k, room):
            if k == len(units):
                return 0
            return min((cost[units[k], j] + best(k + 1, (*room[:j], room[j] - 1, *room[j + 1 :])) for j in range(m) if room[j]), default=10**9)

        assert sum(cost[a] * v for a, v in flow.items()) == best(0, tuple(room))


def test_rewrite(spark, docs, rows, tmp_path):
    placed = common.cut(reshard.assign(docs, reshard.by_source()))
    touched = reshard.rewrite(docs, placed, str(tmp_path / "out"))
    assert touched == reshard.rewrite(docs, placed, str(tmp_path / "out"))  # once more, as after a failure
    back = spark.read.parquet(str(tmp_path / "out"))
    want = placed.where(F.col("shard").isin(touched))
    crc = F.crc32(F.coalesce("text", F.lit("")))
    assert table_of(back.select("doc_id", crc, F.col("_shard").cast("int"))) == table_of(want.select("doc_id", "text_crc32", "shard"))


def test_last_stage_carries_the_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = dict(corpus_pipeline.STAGES)["sharding"](spark, df, None)
    assert out.columns == [*df.columns, "shard", "slot"]
    got = out.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(map(tuple, rows), key=repr)
    placed = reshard.assign(df, reshard.by_source()).collect()
    assert sorted((r.shard, r.slot, r.doc_id or -1) for r in got) == sorted((r.shard, r.slot, r.doc_id or -1) for r in placed)


# ------------------------------------------------------------ toxicity


def labelled(seed=0, n=600):
    rng = random.Random(seed)
    bad = ["groloxian", "groloxist", "groloxing", "vilgruk"]
    texts, labels = [], []
    for k in range(n):
        w = prose(rng, rng.randint(20, 200)).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, labels = labelled()
    texts += [(9001, ""), (9002, None), (None, "some text"), (9003, "unseen groloxer groloxer here"), texts[0]]
    docs = spark.createDataFrame([(*x, "clash") for x in texts], "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, lab).collect()
    assert len(got) == len(texts)
    truth = {k: t for k, _, t in labels}
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in got) == len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    mine = [r for r in held if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in mine) >= 0.97 * len(mine)


def test_toxicity_edges(spark, empty):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, lab).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.score for r in toxicity.score(docs, lab).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([(k, f"word{k} text") for k in range(40)], "doc_id long, text string")
    assert all(r.predicted == 0 for r in toxicity.score(many, one).collect())


def test_grams_of_words():
    buf = np.frombuffer(b"ab cde", np.uint8)
    word, gram = toxicity.events(buf, np.array([0, 3]), np.array([2, 6]))
    told = [int(g).to_bytes(6, "big").lstrip(b"\0") for g in gram]
    assert word.tolist() == [0, 0, 0, 1, 1, 1, 1]
    assert told == [b" a", b" ab", b" ab ", b" c", b" cd", b" cde", b" cde "]


def brute_ratios(rows):
    """(log-ratio of every gram, of every context) of (text, toxic) rows, by plain dictionaries."""
    n = [Counter(), Counter()]
    for t, c in rows:
        for w in WORD.findall(t.lower()):
            b = f" {w} ".encode()
            for k in range(1, len(b)):
                n[c][b[max(0, k - 5) : k + 1]] += 1
    grams = set(n[0]) | set(n[1])
    d = [(lambda one, two: one / max(1, one + 2 * two) or 0.5)(*(sum(v == k for v in n[c].values()) for k in (1, 2))) for c in (0, 1)]
    # the shared model: grams of each lower order are counted by the different grams of the next one
    kinds_of, types = {}, {g.rjust(6, b"\0") for g in grams}
    for k in (5, 4, 3, 2, 1):
        kinds_of[k] = Counter(g[1:] for g in types)
        types = set(kinds_of[k])

    def low(g):
        n_of, ctx = kinds_of[len(g)], g[:-1]
        mine = [v for x, v in n_of.items() if x[:-1] == ctx] if ctx not in cells[len(g)] else cells[len(g)][ctx]
        cells[len(g)][ctx] = mine
        if len(g) == 1:
            return n_of[g] / sum(mine)
        if g not in lows:
            lows[g] = (n_of[g] - 0.75 + 0.75 * len(mine) * low(g[1:])) / sum(mine)
        return lows[g]

    cells, lows = {k: {} for k in kinds_of}, {}
    total, kinds = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for g, v in n[c].items():
            total[c][g[:-1]] += v
            kinds[c][g[:-1]] += 1

    def rest(c, ctx):
        return d[c] * kinds[c][ctx] / total[c][ctx] if total[c][ctx] else 1.0

    def prob(c, g):
        ctx = g[:-1]
        return (max(n[c][g] - d[c], 0) / total[c][ctx] if total[c][ctx] else 0.0) + rest(c, ctx) * low(g.rjust(6, b"\0")[1:])

    number = lambda b: int.from_bytes(b, "big")
    return {number(g): np.log(prob(1, g) / prob(0, g)) for g in grams}, {number(x): np.log(rest(1, x) / rest(0, x)) for x in {g[:-1] for g in grams}}


def brute_features(text, grams, contexts):
    """The three features of a text, a word at a time."""
    each, size = [], []
    for w in WORD.findall(text.lower()):
        b = f" {w} ".encode()
        keys = [int.from_bytes(b[max(0, k - 5) : k + 1], "big") for k in range(1, len(b))]
        each.append(sum(grams[g] if g in grams else contexts.get(g >> 8, 0.0) for g in keys))
        size.append(len(keys))
    return [sum(each) / max(1, sum(size)), max([0, *each]), max([0, *(x / n for x, n in zip(each, size))])]


def test_toxicity_model_is_whole(spark):
    """Every gram and context of the counts is in the table; no two of them share a place there."""
    texts, labels = labelled(3, 200)
    rows = [(t, x[2]) for (_, t), x in zip(texts, labels)]
    got = {r.key: r.ratio for r in toxicity.ratios(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    grams, contexts = brute_ratios(rows)
    want = grams | {k + toxicity.CONTEXT: v for k, v in contexts.items()}
    want = {k: v for k, v in want.items() if abs(v) >= 0.02}
    assert {k: v for k, v in got.items() if abs(v) >= 0.02} == pytest.approx(want, abs=1e-5)


def test_weak_grams_are_not_unseen(spark):
    """Features equal those of the untruncated model; only grams without a count back off."""
    texts, labels = labelled(5, 200)
    rows = [(t, x[2]) for (_, t), x in zip(texts, labels)]
    grams, contexts = brute_ratios(rows)
    assert any(0 < abs(v) < 0.02 for v in grams.values())
    asked = [t for _, t in texts[:30]] + ["Unseen groloxer zzz", "groloxian", ""]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")

    def told(r, x):
        return pa.RecordBatch.from_arrays([r.column("doc_id"), *(pa.array(x[:, k]) for k in range(3))], names=["doc_id", "a", "b", "c"])

    model = toxicity.ratios(spark.createDataFrame(rows, "text string, toxic int"))
    got = {r.doc_id: r[1:] for r in toxicity.look_up(df, model, told, "doc_id long, a double, b double, c double").collect()}
    for k, t in enumerate(asked):
        assert list(got[k]) == pytest.approx(brute_features(t, grams, contexts), abs=1e-4)


def test_toxicity_chunks(spark):
    """Chunks of any size give the scores that the whole table gives."""
    texts, labels = labelled(4, 200)
    docs = spark.createDataFrame([*texts, (None, None), (7, "")], "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = table_of(toxicity.score(docs, lab))
    parts = table_of(toxicity.score(docs, lab, chunk_bytes=5000, most_keys=100))
    assert [r[:2] for r in parts] == [r[:2] for r in whole] and [r[2] for r in parts] == pytest.approx([r[2] for r in whole], abs=1e-9)


# ------------------------------------------------------------ pipeline and queries


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, sf))
        out[name] = docs
    every = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    good = {r.doc_id for r in out["quality_rules"].collect()}
    verdict = {r.doc_id for r in quality.judge(common.table(spark, sf, "documents")).collect() if r.kept}
    assert good == verdict
    classes = dict(brute_classes([(k, every[k]) for k in sorted(good)]))
    assert {r.doc_id for r in out["near_duplicates"].collect()} == set(classes.values())
    hits = {r.doc_id for r in decontam.overlaps(out["near_duplicates"], common.table(spark, sf, "benchmark")).collect()}
    clean = {r.doc_id for r in out["decontamination"].collect()}
    assert clean == set(classes.values()) - hits
    items = [r.text for r in common.table(spark, sf, "benchmark").collect()]
    assert not any(i in every[k] for i in items for k in clean)
    copies = Counter(r.doc_id for r in out["mixing"].collect())
    assert set(copies) <= clean and max(copies.values()) <= 2
    assert Counter(r.doc_id for r in out["sharding"].collect()) == copies
    assert out["mixing"].columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        rel = con.execute(ORACLES[name])
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == sorted(df.columns)
        want = [tuple(dict(zip(cols, r))[c] for c in df.columns) for r in rel.fetchall()]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
