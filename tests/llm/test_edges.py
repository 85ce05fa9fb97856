"""Very long texts through every operator, and the pipeline's stages on nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import automaton_dedup, bagminhash, common, decontam, mixing, quality, reshard, secret_scan, suffix_dedup, toxicity

from .conftest import CLASHES, SCHEMA, prose

LONG = 16 << 20
UNITS = {0: "a", 1: "w ", 2: "ab ", 3: "some line of words here\n"}


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Texts of 16 MB: one byte, one word, a word of two letters, one line; and short ones."""
    path = f"file://{tmp_path_factory.mktemp('long')}/d"
    rows = [(k, u, LONG // len(u)) for k, u in UNITS.items()] + [(9, "a short text of a few words", 1)]
    df = spark.createDataFrame(rows, "doc_id long, unit string, n int").repartition(5, "doc_id")
    df.select("doc_id", F.expr("repeat(unit, n)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).write.parquet(path)
    return spark.read.parquet(path)


def whole(k):
    return UNITS[k] * (LONG // len(UNITS[k]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_bytes(long_docs):
    got = {r.doc_id: r for r in suffix_dedup.dedup(long_docs).collect()}
    for k in UNITS:
        n = len(whole(k))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (n, n, 1, sha("")), k
    assert got[9].n_removed == 0


def test_long_texts_words(long_docs):
    got = {r.doc_id: r for r in automaton_dedup.dedup(long_docs).collect()}
    assert (got[0].n_words, got[0].n_removed, got[0].kept_sha256) == (1, 0, sha(whole(0)))
    # the first window stays but for what later windows cover
    for k, kept in ((1, "w"), (2, "ab"), (3, "some line of words here")):
        n = len(whole(k).split())
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (n, n - len(kept.split()), sha(kept)), k
    assert got[9].n_removed == 0


def shorter(long_docs, *ids):
    """Some of the texts, a quarter as long: what these operators do with a text grows with its length alone."""
    return long_docs.where(F.col("doc_id").isin(*ids)).withColumn("text", F.expr("substr(text, 1, octet_length(text) div 4)"))


def quarter(k):
    return whole(k)[: len(whole(k)) // 4] if k in UNITS else "a short"


def test_long_texts_rules_and_scans(spark, long_docs):
    long_docs = shorter(long_docs, 0, 3, 9)
    judged = {r.doc_id: r for r in quality.judge(long_docs).collect()}
    assert [judged[k].n_words for k in (0, 3)] == [len(quarter(k).split()) for k in (0, 3)]
    assert judged[3].n_dup_lines == sum(x.strip() != "" for x in quarter(3).split("\n")) - len({x for x in quarter(3).split("\n") if x.strip()}) and judged[3].n_repeat_words == judged[3].n_words
    assert [judged[k].kept for k in (0, 3, 9)] == [False] * 3 and quality.keep_good(long_docs).count() == 0
    found = {r.doc_id: r for r in secret_scan.scan(long_docs).collect()}
    assert found[0].spans == f"hex:0:{LONG // 4}" and found[3].spans == ""
    item = spark.createDataFrame([(1, "ab " * 60), (2, "of words here some line of words here"), (3, "some line of words here " * 20)], "item_id long, text string")
    hits = {(r.doc_id, r.item_id): r.n_equal for r in decontam.overlaps(long_docs, item).collect()}
    assert hits == {(3, 2): 8, (3, 3): 100} and {r.doc_id for r in decontam.keep_clean(long_docs, item).collect()} == {0, 9}


def test_long_texts_corpus(spark, long_docs):
    long_docs = shorter(long_docs, 0, 1, 9)
    same = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(long_docs).collect()}
    assert same == {k: k for k in (0, 1, 9)} and bagminhash.keep_one(long_docs).count() == 3
    sizes = {r.doc_id: r.size for r in mixing.mix(long_docs).collect()}
    assert sizes[1] == LONG // 8 and mixing.mixed(long_docs).count() >= 3
    placed = {r.doc_id: r.size for r in reshard.assign(long_docs, reshard.by_source()).collect()}
    assert placed[0] == LONG // 4 + 1 and reshard.resharded(long_docs, reshard.by_source()).count() == 3
    labels = spark.createDataFrame([(k, 1, int(k == 1)) for k in (0, 1, 9)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(long_docs, labels).collect())


def edge_rows(rows):
    rng = __import__("random").Random(12)
    long = " ".join(prose(rng, 300) for _ in range(40))
    return [*rows, (500, long, "en", "src1", 1), (501, long, "en", None, 1), (501, long, "en", None, 1)]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, sf, rows, stage):
    """Each stage alone: no crash, the columns of its input, only rows of its input, and nothing from nothing."""
    f = dict(corpus_pipeline.STAGES)[stage]
    mine = edge_rows(rows)
    docs = spark.createDataFrame(mine, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in CLASHES if stage != "sharding" or c != "shard"})
    out = f(spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = [tuple(r)[:5] for r in out.collect()]
    assert set(got) <= set(mine)
    none = f(spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == out.columns
    if stage == "quality_rules":
        # a rule's verdict is a matter of the text alone, so repeated rows stay or go together
        assert all((r in got) == (s in got) for r in mine for s in mine if (r[1] or "") == (s[1] or ""))
    if stage == "near_duplicates":
        assert len(got) == len(set(got)) and len({r[1] or "" for r in got}) == len(got)
    if stage == "sharding":
        assert sorted(got, key=repr) == sorted(mine, key=repr)


def test_all_stages_in_a_row(spark, sf, rows):
    docs = spark.createDataFrame(edge_rows(rows), SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        docs = common.cut(f(spark, docs, sf))
    assert docs.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), "shard", "slot"] and docs.count() > 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        empty = common.cut(f(spark, empty, sf))
    assert empty.count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def brute_against_windows(docs, length):
    """Bytes that repeated windows cover, by 128-bit digests of all windows."""
    seen, out = {}, {}
    for _, t in docs:
        for k in range(len(t) - length + 1):
            h = hashlib.blake2b(t[k : k + length], digest_size=16).digest()
            seen[h] = seen.get(h, 0) + 1
    for doc_id, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[k : k + length], digest_size=16).digest()] > 1:
                gone[k : k + length] = b"\1" * length
        out[doc_id] = (len(t), sum(gone), hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest())
    return out


def test_suffix_array_on_the_table(spark, sf):
    d = common.table(spark, sf, "documents")
    want = brute_against_windows([(r.doc_id, (r.text or "").encode()) for r in d.collect()], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(d).collect()}
    assert got == want and any(n for _, n, _ in want.values())


def test_the_rule_is_400_bytes_not_51_words(spark):
    """A passage of 51 words goes from 400 bytes on; one byte less, or other white space, and all of it stays."""
    words = [f"w{k:02d}" + "abcd"[: k % 3 + 2] for k in range(51)]
    words[-1] += "z" * (400 - len(" ".join(words)))
    at = " ".join(words)
    under, wide = "q" + at[2:], " ".join(f"é{k:02d}mot" for k in range(51))  # 399 bytes; 407 bytes of 356 characters
    assert (len(at), len(under), len(wide.encode()), len(wide)) == (400, 399, 407, 356)
    assert [len(x.split()) for x in (at, under, wide)] == [51] * 3
    reflowed = " ".join(f"v{k:02d}enough" for k in range(51))  # 509 bytes
    texts = [f"a {at} b", f"c {at} d", f"e\n{under}\nf", f"g\t{under}\th", f"i {wide} j", f"k {wide} l", f"m {reflowed}", f"n {reflowed}".replace(" v25", "\nv25")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (402, 1), 1: (402, 1), 2: (0, 0), 3: (0, 0), 4: (409, 1), 5: (409, 1), 6: (0, 0), 7: (0, 0)}
