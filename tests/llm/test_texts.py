"""Operators that judge or clean single texts, against plain Python."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import automaton_dedup, chat_tools, common, decontam, quality, secret_scan, suffix_dedup

from .conftest import prose, table_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_words_and_hashes():
    texts = ["a  bc\td", "", None, " x ", "bc", "\n\né ß", "d"]
    buf, off = common.buffer_of(pa.array(texts).slice(0))
    w = common.words(buf, off)
    want = [(k, m.encode()) for k, t in enumerate(texts) for m in WORD.findall(t or "")]
    got = [(int(d), buf[a:b].tobytes()) for d, a, b in zip(w.doc, w.starts, w.ends)]
    assert got == want and w.counts.tolist() == [3, 0, 0, 1, 1, 2, 1]
    by = {}
    for (_, x), h in zip(want, w.hash.tolist()):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    sliced = pa.array(texts).slice(3, 2)
    assert common.buffer_of(sliced)[0].tobytes() == b" x bc"


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 7, 64, 300, 301):
        assert common.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def measures(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = {j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(k, k + 3)} if len(w) < 2000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), hit if hit is None else len(hit)


def test_quality_measures(docs, rows, empty):
    got = {}
    for r in quality.judge(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, *_ in rows:
        n, chars, symbols, dups, repeats = measures(text or "")
        mine = [r for r in got[doc_id] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dups)]
        assert mine, doc_id
        if repeats is not None:
            assert mine[0].n_repeat_words == repeats
            assert mine[0].base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (mine[0].base_failed and mine[0].kept)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_cascade_order_changes_no_verdict(docs):
    rules = quality.BASE_RULES + quality.EXTRA_RULES
    one = table_of(quality.keep_good(docs, rules).select("doc_id", "text", "size"))
    assert one == table_of(quality.keep_good(docs, rules[::-1]).select("doc_id", "text", "size"))
    texts = pa.array([r.text for r in docs.select("text").collect()])
    buf, off = common.buffer_of(texts)
    alone = np.any([r.rejects(quality.Measures(buf, off)) for r in rules], axis=0)
    for order in (rules, rules[::-1]):
        assert ((quality.cascade(quality.Measures(buf, off), order) >= 0) == alone).all()
    ranked = [r.name for r in quality.plan(docs, rules)]
    assert sorted(ranked) == sorted(r.name for r in rules)


def test_quality_rejects_junk(spark):
    rng = random.Random(3)
    clean = prose(rng, 300)
    junk = [clean.upper(), " ".join(w + "$$$" for w in clean.split()), "!! ".join(clean.split()), ("same line of words here\n") * 40]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([clean, *junk])], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep_good(df).collect()] == [0]


def brute_spans(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    rank = ("assign", "access", "hex").index
    return sorted(out, key=lambda x: (x[1], rank(x[0])))


def test_secrets(spark, docs, rows, empty):
    rng = random.Random(1)
    alphabet = secret_scan.ALPHABETS["base62"]
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    made = [f"name{k}aaaaaaaaaaaaaaaabbbbbbbbbbbbbbbbbbbb{k}" for k in range(60)]
    texts = [f"é {k} and {m} " for k, m in zip(keys, made)]
    texts += ["token=token=abcdef123456", "secret: token:abcdefabcdefabcdef", "API_KEY = 'abcdefghijkl'", "AKIA" + "Z" * 14 + " AKIAAKIA1", "deadbeefdeadbeef0 deadbeef", "", None, "toſecret=abcdefghijklmnop password=short"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = 0
    for r in secret_scan.scan(df).collect():
        t = texts[r.doc_id] or ""
        want = brute_spans(t)
        told = [f"{k}:{a}:{b}" for k, a, b in want]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(told) <= set(spans)
        if r.doc_id < 60:
            a = t.index(keys[r.doc_id])
            found += f"random:{a}:{a + 40}" in spans
            assert sum(s.startswith("random") for s in spans) <= 1
    assert found >= 50
    assert secret_scan.scan(docs).count() == len(rows) and secret_scan.scan(empty).count() == 0


def test_values_are_parted_from_their_names(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choice(secret_scan.ALPHABETS["base62"]) for _ in range(40)) for _ in range(90)]
    shapes = ["set client_key={} now", "auth={}", "https://host/x?sig={}&y=1", "a_very_long_name_of_a_key_1={}", "pad {}== end"]
    texts = [shapes[k % 5].format(x) for k, x in enumerate(keys)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = Counter()
    for r in secret_scan.scan(df).collect():
        a = texts[r.doc_id].index(keys[r.doc_id])
        found[r.doc_id % 5] += f"random:{a}:{a + 40 + 2 * (r.doc_id % 5 == 4)}" in r.spans.split(",")
    assert all(found[k] >= 15 for k in range(5)), found


def test_base_findings_are_tested(spark):
    rng = random.Random(9)
    drawn = "".join(rng.choice(secret_scan.ALPHABETS["base62"]) for _ in range(40))
    texts = [f"token = {drawn}", "token = aaaaaaaaaaaaaaaaaaaaaaaa", "deadbeefdeadbeefdeadbeef", "password: not.a.key.at.all", "AKIA" + "Q7R2ZK9W4M1X5T8B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base_tests.split(",")[0].split(":") for r in secret_scan.scan(df).collect()}
    assert got[0][:4] == ["assign", "0", "48", "base62"] and float(got[0][4]) > 0.01
    assert float(got[1][4]) < 1e-6 and float(got[2][4]) < 0.05 and got[3][3:] == ["", ""] and got[4][0] == "access"


@pytest.mark.parametrize("size", [1, 3, 20])
def test_recall_of_small_classes(size):
    """Of random keys of a class with few members, at least nine in ten are found, alone or beside made-up names."""
    rng = np.random.default_rng(size)
    found = total = 0
    for _ in range(300 // size):
        p = [secret_scan.battery(rng.integers(0, 62, 40), 62) for _ in range(size)]
        counts = [0] * secret_scan.BINS
        for x in p:
            counts[min(int(x * secret_scan.BINS), secret_scan.BINS - 1)] += 1
        limit = secret_scan.thresholds({"base62/40": counts})["base62/40"]
        found += sum(x >= limit for x in p)
        total += size
    assert found >= 0.9 * total, (found, total)


def test_rare_classes_share_thresholds():
    def bins(**at):
        return [at.get(f"b{k}", 0) for k in range(secret_scan.BINS)]

    lone, many = bins(b20=1), [10] * secret_scan.BINS
    assert secret_scan.thresholds({"base62/40": lone})["base62/40"] <= 20 / 64
    assert secret_scan.thresholds({"base62/40": lone, "base62/64": many, "base36/40": bins(b0=900)})["base62/40"] <= 20 / 64
    made = bins(b0=500, b1=300, b20=40)
    assert secret_scan.thresholds({"base62/40": made}) == {"base62/40": 2.0}
    assert secret_scan.thresholds({"base62/40": lone, "base62/48": made})["base62/40"] == 2.0


def test_battery_is_uniform_on_random_strings():
    rng = np.random.default_rng(5)
    p = np.array([secret_scan.battery(rng.integers(0, 64, 48), 64) for _ in range(2000)])
    assert abs((p < 0.1).mean() - 0.1) < 0.04 and abs((p < 0.5).mean() - 0.5) < 0.08
    words = np.array([secret_scan.battery(rng.integers(26, 36, 48), 64) for _ in range(200)])
    assert (words < 1e-3).mean() > 0.95
    assert abs(secret_scan.chi2_tail(3.84, 1) - 0.05) < 1e-3 and abs(secret_scan.chi2_tail(18.31, 10) - 0.05) < 1e-3


@pytest.mark.parametrize("change", [0, 1, 3])
def test_decontamination(spark, change):
    rng = random.Random(change)
    items = [prose(rng, n) for n in (30, 18, 40)] + ["", None, "tiny item here"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    texts = []
    for t in items[:3]:
        w = t.split()
        for k in rng.sample(range(1, len(w) - 1), change):
            w[k] = "changed"
        texts.append(prose(rng, 50) + ", " + " ".join(w).upper() + "! " + prose(rng, 50))
    texts += [prose(rng, 200), "", None, "a tiny item here too", " ".join(items[0].split()[:12])]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, item_id long")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (6, 5)}
    assert {r.doc_id for r in decontam.keep_clean(docs, bench).collect()} == {3, 4, 5, 7}
    assert got == {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench, block_windows=20).collect()}
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0 and decontam.keep_clean(docs.limit(0), bench).count() == 0


def brute_hits(items, h, first):
    """Best passages by trying every diagonal and every run."""
    out = []
    for t in range(len(first) - 1):
        x = h[first[t] : first[t + 1]]
        for k, item in enumerate(items):
            best = None
            for d in range(-len(item) + 1, len(x)):
                a, b = max(0, -d), min(len(item), len(x) - d)
                eq = item[a:b] == x[a + d : b + d]
                run = max(((j - i + 1, -i) for i in np.flatnonzero(eq) for j in np.flatnonzero(eq) if j >= i and eq[i : j + 1].sum() >= 0.8 * (j - i + 1) - 1e-9), default=(0, 0))
                if run[0] and run[0] >= decontam.needed(len(item), 0.8):
                    s = -run[1] + a + d
                    n = int(eq[-run[1] : -run[1] + run[0]].sum())
                    if best is None or (n, -d) > (best[0], -best[1]):
                        best = (n, d, s, s + run[0])
            if best:
                out.append((t, k, best[2], best[3], best[0]))
    return out


@pytest.mark.parametrize("pairs", [1 << 21, 3])
def test_hits_against_brute_force(monkeypatch, pairs):
    """Few different tokens, so seeds repeat in items and texts; with small steps every way to make meetings is taken."""
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    rng = np.random.default_rng(pairs)
    for _ in range(60):
        kinds = rng.integers(1, 1 << 62, int(rng.integers(2, 9)), dtype=np.uint64)
        items = [rng.choice(kinds, int(rng.integers(1, 14))) for _ in range(4)]
        texts = [rng.choice(kinds, int(rng.integers(0, 30))) for _ in range(4)]
        first = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        assert list(decontam.Block(list(range(4)), items, decontam.MASKS).hits(np.concatenate(texts), first)) == brute_hits(items, np.concatenate(texts), first)


def test_repeated_tokens_stay_cheap():
    """A text of a million bytes of one word, or of a few in turn, against an item of the same."""
    import time

    for unit in ("w ", "a b ", "a b c d e f g "):
        item = decontam.tokens(pa.array([unit * (400 // len(unit))]))
        block = decontam.Block([0], [item.hash], decontam.MASKS, words=[decontam.spelled(item)])
        began = time.perf_counter()
        w = decontam.tokens(pa.array([unit * ((1 << 20) // len(unit))]))
        n = len(item.hash)
        assert list(block.hits(w.hash, w.first, w)) == [(0, 0, 0, n, n)]
        assert time.perf_counter() - began < 60


def test_every_substitution_within_the_rule_is_found():
    """All ways to replace a fifth of the tokens, for items of 1 to 16 tokens; random ways for longer ones."""
    rng = np.random.default_rng(0)
    for n in [*range(1, 17), 20, 24, 31, 45, 80]:
        item = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        ways = list(itertools.combinations(range(n), n // 5)) if n <= 16 else [rng.permutation(n)[: n // 5] for _ in range(300)]
        texts = []
        for way in ways:
            t = item.copy()
            t[list(way)] = rng.integers(1, 1 << 62, len(way), dtype=np.uint64)
            texts.append(np.concatenate((rng.integers(1, 1 << 62, 5, dtype=np.uint64), t, rng.integers(1, 1 << 62, 5, dtype=np.uint64))))
        first = np.arange(len(texts) + 1) * (n + 10)
        block = decontam.Block([0], [item], decontam.MASKS)
        assert [x[0] for x in block.hits(np.concatenate(texts), first)] == list(range(len(ways))), n


def test_long_run_of_a_longer_item_is_found():
    rng = np.random.default_rng(1)
    item, other = rng.integers(1, 1 << 62, 300, dtype=np.uint64), rng.integers(1, 1 << 62, 40, dtype=np.uint64)
    texts = [np.concatenate((other, item[100 : 100 + n], other[::-1])) for n in (decontam.RUN, decontam.RUN // 2)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = list(decontam.Block([0], [item], decontam.MASKS).hits(np.concatenate(texts), first))
    assert found == [(0, 0, 40, 40 + decontam.RUN, decontam.RUN)]


def test_best_run():
    assert decontam.best_run(np.array([0, 1, 1, 1, 1, 0, 1, 1, 0, 0, 0, 1], bool), 0.8) == (7, 1, 8)
    assert decontam.best_run(np.zeros(4, bool), 0.8) == (0, 0, 0)


# ------------------------------------------------------------ repeats


def order(rows):
    return sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).digest()))


def brute_bytes(rows, length):
    seen = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for doc_id, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cap", [500, 2])
def test_suffix_array_dedup(docs, rows, empty, cap):
    plan = suffix_dedup.Plan(400, 32, False, suffix_dedup.match, False, cap)
    assert table_of(suffix_dedup.dedup(docs, plan)) == brute_bytes(rows, 400)
    assert suffix_dedup.dedup(empty).count() == 0


def brute_words(rows, length):
    seen, out = set(), []
    # texts that differ under one id stand in the order of the operator's node numbers, which only matters if they share a window
    for k in order(rows):
        doc_id, t = rows[k][:2]
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            x = tuple(w[a : a + length])
            if x in seen:
                gone[a : a + length] = [True] * length
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cap", [500, 2])
def test_automaton_dedup(docs, rows, empty, cap):
    plan = automaton_dedup.Plan(20, 5, True, automaton_dedup.match, True, cap)
    assert table_of(automaton_dedup.dedup(docs, plan)) == brute_words(rows, 20)
    assert automaton_dedup.dedup(empty).count() == 0


def test_against_a_reference(spark, docs, rows, empty):
    """Every stretch of 20 words that a reference text holds, over any number of automata; and the rule of
    :func:`automaton_dedup.dedup` for the same reference put in front of the documents."""
    ref = [rows[k][1] for k in (3, 45, 60, 70)] + ["", None, "too short to matter"]
    reference = spark.createDataFrame([(t,) for t in ref], "text string")
    held = {tuple(w[k : k + 20]) for t in ref for w in [WORD.findall(t or "")] for k in range(len(w) - 19)}
    want = []
    for doc_id, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in held:
                gone[k : k + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for size in (1 << 18, 400):
        assert table_of(automaton_dedup.against(docs, reference, shard_bytes=size).drop("spans")) == sorted(want, key=repr)
    assert automaton_dedup.against(empty, reference).count() == 0 and automaton_dedup.against(docs, empty).where("n_removed > 0").count() == 0
    # the streamed automata and the routed windows agree: only what the reference holds is compared
    first = [(-9 + k, t) for k, t in enumerate(ref)]
    alone = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] < 30]
    both = spark.createDataFrame(first + alone, "doc_id long, text string")
    routed = {r.doc_id: r.n_removed for r in automaton_dedup.dedup(both).collect()}
    streamed = {r.doc_id: r.n_removed for r in automaton_dedup.against(spark.createDataFrame(alone, "doc_id long, text string"), reference).collect()}
    assert all(routed[k] >= n for k, n in streamed.items()) and streamed[3] == routed[3] > 0


def thue_morse(n, one="a", two="b"):
    t = one
    while len(t) < n:
        t += t.translate(str.maketrans(one + two, two + one))
    return t, t.translate(str.maketrans(one + two, two + one))


def test_doubling_patterns_are_no_equal_texts(spark):
    """Strings that sums modulo a power of two cannot tell apart are different lines, words and windows."""
    a, b = thue_morse(1024)
    assert a != b
    buf = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    w = common.words(buf, np.array([0, len(buf)]))
    assert w.hash[0] == w.hash[2] != w.hash[1] and w.classes[0][0] == w.classes[0][2] != w.classes[0][1]
    rest = [f"w{k}" for k in range(24)]
    texts = [f"{a}\n{b}\n", " ".join([a, *rest]), " ".join([b, *rest]), f"{a} x y {b} x y {a} z", (a + "c") * 2, (b + "c") * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[0].n_dup_lines == 0 and got[3].n_repeat_words == 0
    rows = list(enumerate(texts))
    assert table_of(automaton_dedup.dedup(df)) == brute_words(rows, 20)
    assert table_of(suffix_dedup.dedup(df)) == brute_bytes(rows, 400)
    bench = spark.createDataFrame([(1, f"{a} one two three four"), (2, " ".join([a] * 5))], "item_id long, text string")
    hits = spark.createDataFrame([(1, f"{b} one two three four five"), (2, " ".join([b] * 5))], "doc_id long, text string")
    assert [(r.doc_id, r.n_equal) for r in decontam.overlaps(hits, bench).collect()] == [(1, 4)]


def test_classes_under_one_hash():
    """Spans of equal hashes are parted by their bytes, however many there are."""
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 100, 4000).astype(np.uint8)
    s = rng.integers(0, 3000, 400)
    e = s + rng.integers(0, 3, 400) + np.where(rng.random(400) < 0.1, 700, 0)
    for h in (np.zeros(400, np.uint64), (s % 7).astype(np.uint64) * np.uint64(0), common.span_hash(common.prefix_hash(buf), s, e)):
        number, first = common.exact(buf, s, e, h)
        names = [buf[a:b].tobytes() for a, b in zip(s, e)]
        assert len(set(zip(names, number.tolist()))) == len(set(names)) == len(set(number.tolist())) == len(first)
        assert all(names[first[n]] == x for n, x in zip(number.tolist(), names))


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 5))
        t = rng.integers(65, 65 + k, n).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, n // 7)], 8)
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == want and suffix_dedup._by_doubling(t).tolist() == want
        _, lcp = suffix_dedup.common_prefixes(t, sa, np.array([0]), 10**6)
        for x, y in zip(want, want[1:]):
            m = 0
            while x + m < len(b) and y + m < len(b) and b[x + m] == b[y + m]:
                m += 1
            assert lcp[y] == m


def test_suffix_automaton():
    rng = np.random.default_rng(1)
    for _ in range(100):
        seqs = [rng.integers(0, 3, int(rng.integers(1, 30))).tolist() for _ in range(6)]
        a = automaton_dedup.Automaton()
        for q in seqs[:-1]:
            a.add(q)
        parts = {tuple(q[i:j]) for q in seqs[:-1] for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
        whole, held = automaton_dedup.Automaton(), set()
        for q in seqs:
            told = [max(m for m in range(e + 2) if m == 0 or tuple(q[e + 1 - m : e + 1]) in held | {tuple(q[i:j]) for j in range(e + 1) for i in range(j)}) for e in range(len(q))]
            assert whole.read(q) == told
            held |= {tuple(q[i:j]) for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
        last = seqs[-1]
        want = [max(m for m in range(e + 2) if m == 0 or tuple(last[e + 1 - m : e + 1]) in parts) for e in range(len(last))]
        assert a.statistics(last) == want


# ------------------------------------------------------------ chat


def link_rows(spark, messages, schemas):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    return chat_tools.link(df.selectExpr("*", "'clash' AS kind", "1 AS at"), schemas)


def calls(*cs, content=""):
    return json.dumps({"content": content, "tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in cs]})


def result(cid, content="r"):
    return json.dumps({"tool_call_id": cid, "content": content})


def test_chat_links(spark):
    f = {"f": {"type": "object", "properties": {"x": {}}, "additionalProperties": False}}
    m = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", calls(("b", "f", {"x": "$a"}), ("a", "f", {"x": 1.0}), ("q", "g", {}), ("z", "f", {"y": 2}), ("", "f", {}), content="ok")),
        (1, 2, "tool", result("b")),
        (1, 3, "tool", result("a")),
        (1, 4, "tool", result("a", "again")),
        (1, 5, "tool", result("nope")),
        (2, 0, "assistant", calls(("u", "f", {"x": "$v"}), ("v", "f", {"x": "$u"}), ("w", "f", {"x": "$gone"}))),
        (2, 1, "assistant", "{not json tool_calls"),
        (None, None, None, None),
        (3, 0, "assistant", calls(*((f"c{k}", "f", {"x": f"$c{k + 1}"} if k < 6 else {}) for k in range(7)))),
        (4, 0, "assistant", calls(("a", "f", {}))),
        (4, 0, "assistant", calls(("a", "f", {}))),
    ]
    got = link_rows(spark, m, f).collect()
    status = sorted((r.conv_id or 0, r.kind, r.call_id or "", r.status) for r in got)
    assert status == sorted(
        [(0, "message", "", "message"), (1, "message", "", "message"), (1, "message", "", "message"), (1, "call", "a", "ok"), (1, "call", "b", "ok"), (1, "call", "q", "unknown_tool"), (1, "call", "z", "invalid"), (1, "call", "", "malformed")]
        + [(1, "result", "a", "ok"), (1, "result", "a", "duplicate"), (1, "result", "b", "ok"), (1, "result", "nope", "orphan")]
        + [(2, "call", "u", "cyclic"), (2, "call", "v", "cyclic"), (2, "call", "w", "dangling"), (2, "message", "", "message")]
        + [(3, "call", f"c{k}", "unanswered") for k in range(7)]
        + [(4, "call", "a", "unanswered"), (4, "call", "a", "duplicate")]
    )
    seq = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == 1 and r.status == "ok"), key=lambda r: (r.at, r.level, r.turn, r.idx))]
    assert seq == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    chain = [r.call_id for r in sorted((r for r in got if r.conv_id == 3), key=lambda r: (r.at, r.level))]
    assert chain == [f"c{k}" for k in range(6, -1, -1)]
    assert {r.json for r in got if r.conv_id == 1 and r.call_id == "a" and r.kind == "call"} == {'{"arguments":{"x":1},"id":"a","name":"f"}'}
    assert link_rows(spark, [], f).count() == 0


def test_conversations_of_any_size(spark):
    """Ordering in a task and by rounds of joins give the same; a chain of a thousand calls takes no thousand jobs."""
    f = {"f": {"type": "object"}}
    rng = random.Random(6)
    m = [(7, 0, "assistant", calls(*((f"k{k}", "f", {"x": f"$k{k + 1}"} if k < 999 else {}) for k in range(1000))))]
    for conv in range(3):
        m += [(conv, t, "assistant", calls(*((f"c{t}_{k}", "f", {str(j): f"$c{rng.randrange(6)}_{rng.randrange(3)}" for j in range(rng.randrange(3))}) for k in range(3)))) for t in range(6)]
        m += [(conv, 6 + t, "tool", result(f"c{t}_{k}")) for t in range(6) for k in range(2)]
    m += [(None, 1, "assistant", calls(("a", "f", {"x": "$b"}), ("b", "f", {})))]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    one = table_of(chat_tools.link(df, f))
    small = df.where("conv_id IS NULL OR conv_id < 7")
    assert table_of(chat_tools.link(small, f, most=0)) == [r for r in one if r[0] != 7] and len(one) == len([r for r in one if r[0] != 7]) + 1000
    chain = sorted((r[10], r[5]) for r in one if r[0] == 7)
    assert [c for _, c in chain] == [f"k{k}" for k in range(999, -1, -1)]


def test_hostile_messages(spark):
    f = {"f": {"type": "object", "properties": {"x": {"type": "strange"}}}}
    deep = lambda n: "[" * n + "]" * n
    half = "\\ud800"
    m = [
        (1, 0, "assistant", f'{{"tool_calls":[{{"id":"{half}","name":"f","arguments":{{}}}}]}}'),
        (1, 1, "assistant", f'{{"tool_calls":[{{"id":"a","name":"f","arguments":{{"y":"{half}"}}}}]}}'),
        (1, 2, "tool", f'{{"tool_call_id":"a","content":"{half}"}}'),
        (2, 0, "assistant", f'{{"tool_calls":[{{"id":"a","name":"f","arguments":{{"y":{deep(3000)}}}}}]}}'),
        (2, 1, "assistant", f'{{"tool_calls":[{{"id":"b","name":"f","arguments":{{"y":{deep(200000)}}}}}]}}'),
        (2, 2, "tool", f'{{"tool_call_id":"b","content":{deep(150)}}}'),
        (3, 0, "assistant", calls(("a", "f", {"x": 1}))),
        (4, 0, "user", "long " * 3_000_000),
        (4, 1, "assistant", calls(("a", "f", {"z": "v" * 3_000_000}))),
    ]
    got = {(r.conv_id, r.turn): r for r in link_rows(spark, m, f).collect()}
    assert {k: v.status for k, v in got.items()} == {(1, 0): "malformed", (1, 1): "ok", (1, 2): "ok", (2, 0): "malformed", (2, 1): "malformed", (2, 2): "malformed", (3, 0): "invalid", (4, 0): "message", (4, 1): "unanswered"}
    assert json.loads(got[1, 1].json)["arguments"]["y"] == "\ud800" and json.loads(got[2, 0].json)["content"] == m[3][3]
    assert got[3, 0].errors == ["/x: not strange"] and len(got[4, 1].json) > 3_000_000


def test_canonical_json_round_trip():
    v = {"b": [1.0, 2.5, True, None, "é\n"], "a": {"z": 1, "y": {}}}
    assert chat_tools.canonical(v) == '{"a":{"y":{},"z":1},"b":[1,2.5,true,null,"é\\n"]}'
    assert json.loads(chat_tools.canonical(v)) == v


def test_schema_violations():
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "items": {"enum": ["x"]}}, "c": {"type": "string", "maxLength": 2}}, "additionalProperties": False}
    assert chat_tools.violations({"a": 2.0, "b": ["x"], "c": "ab"}, s) == []
    assert chat_tools.violations({"a": 1, "b": ["y"], "c": "abc", "d": 0}, s) == ["/a: range", "/b/0: not in enum", "/c: length", "/d: not allowed"]
    assert chat_tools.violations({}, s) == ["/a: missing"] and chat_tools.violations([], s) == ["/: not object"]
    assert chat_tools.violations({"a": True}, s) == ["/a: not integer"]


def test_conversations_table(spark, sf):
    conv = common.table(spark, sf, "conversations")
    got = chat_tools.link(chat_tools.as_tool_traffic(conv), chat_tools.REPLY).collect()
    src = {(r.conv_id, r.turn): r for r in conv.collect()}
    assert len(got) == len(src)
    for r in got:
        m = src[r.conv_id, r.turn]
        said = json.loads(r.json)
        if m.role == "user":
            assert r.kind == "call" and said["arguments"]["prompt"] == m.text and said["id"] == f"t{m.turn}"
            answered = src.get((m.conv_id, m.turn + 1))
            assert r.status == ("ok" if answered and answered.role == "assistant" else "unanswered")
        elif m.role == "assistant":
            assert r.kind == "result" and said["content"] == m.text
        else:
            assert r.kind == "message" and said == {"role": m.role, "content": m.text}
