import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

VOCAB = [a + b + c for a in ("an", "be", "co", "du") for b in ("ra", "li", "mo", "tu") for c in ("n", "st", "ver", "x", "ing")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def make_docs(seed=7):
    """Documents with copies, near copies, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 400)) for _ in range(40)]
    base = prose(rng, 200).split()
    for k in range(12):  # near copies of one text
        w = list(base)
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    passage = prose(rng, 90)
    for _ in range(15):  # a passage that many share, behind different words
        texts.append(f"{prose(rng, 40)}\n{passage}\t {prose(rng, 40)}")
    texts += [texts[3]] * 6 + [texts[45]] * 2  # copies
    texts += ["", None, " \n\t ", "one", "one two three", "é" * 500 + " ß", "x " * 900, "line a\nline a\nline b\n" * 30, prose(rng, 6000)]
    rows = [(k, t, "en", f"src{rng.randrange(4)}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[60]]  # repeated rows
    rows += [(None, texts[2], "en", "src1", 1), (None, None, None, None, None), (17, "another text under a known id " + prose(rng, 60), "en", "src2", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["d", "h", "nid", "size", "target", "limit", "times", "label", "key", "runs", "row", "copies", "shard", "owner", "_s", "_d", "n"]


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table_of(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


__all__ = ["Row", "make_docs", "prose", "table_of"]
