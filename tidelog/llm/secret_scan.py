"""Secret scan: known shapes, and a battery of randomness tests for the rest.

Base findings are runs of three fixed shapes (:data:`ASSIGN`, :data:`ACCESS`,
:data:`HEX`), leftmost and non-overlapping for each, as spans of code points.
They stay whatever their characters are; the battery below tells for each, in
``base_tests``, the encoding of its value and a p-value, so that a reader can
part drawn keys from words and placeholders.

Everything else of 20 or more key characters that has a letter and a digit and
overlaps no base finding is a candidate. Its encoding is inferred as the
smallest alphabet that holds it. Three tests ask whether it is a uniform draw
from that alphabet: chi-squared over as many bins as give five expected
characters each, the runs of low and high halves, and the serial correlation
of neighbours; Fisher's method makes one p-value of them. Random strings have
p-values uniform on (0, 1), made-up names have small ones. In each class of
length and encoding the random share is read off the upper half of the
p-value histogram, and the lowest threshold is taken at which the estimated
part of non-random strings among those above it is at most ``rate``. So short
classes, whose tests have little power, need larger p-values. A class of fewer
than ``ENOUGH`` strings also takes the threshold of the nearest lengths of its
encoding that have so many together, if that is lower; where an encoding has
too few at all lengths, the tests decide alone, at the level ``rate``.
Histograms are summed in the cluster; the driver sees classes x bins rows.

Null and empty texts: no findings, the hash of an empty string. Very long texts
are scanned whole; a value of any length is tested whole. Ties: spans that start
at one place stand in the order assign, access, hex, random; a p-value equal to
the threshold is a finding. Repeated rows are scanned alike. Empty table: empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")  # a sign of equality inside parts a name from its value
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
KINDS = ("assign", "access", "hex", "random")
#: Alphabets from the smallest, in coding order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_PLACE = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 128)
BINS, RATE = 64, 0.05
#: Characters of a base finding's value that the battery asks for.
LEAST = 12
#: Strings that a class's random share can be read off.
ENOUGH = BINS


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base findings; the value of an assignment is what follows its sign."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0][4:]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def tested(value: str) -> str:
    """encoding:p-value of a base finding's value; empty fields where no alphabet holds it or it is too short."""
    found = infer(value)
    if not found or len(found[1]) < LEAST:
        return ":"
    return f"{found[0]}:{battery(found[1], len(ALPHABETS[found[0]])):.6f}"


def infer(token: str) -> tuple[str, np.ndarray] | None:
    """Encoding and code values of a token; padding is left out, url-safe signs read as the plain ones."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    have = set(body)
    for name, place in _PLACE.items():
        if have <= place.keys():
            return name, np.array([place[c] for c in body])
    return None


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees, by the regularised incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def battery(values: np.ndarray, size: int) -> float:
    """One p-value for "a uniform draw from ``size`` symbols"."""
    n = len(values)
    bins = max(2, min(size, n // 5))
    cell = values * bins // size
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    chi = float(((np.bincount(cell, minlength=bins) - n * share) ** 2 / (n * share)).sum())
    p = [chi2_tail(chi, bins - 1)]
    high = values >= size // 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z = (int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(var) if var > 0 else 0.0
        p.append(math.erfc(abs(z) / math.sqrt(2)))
    else:
        p.append(2.0 ** (1 - n))
    d = values - values.mean()
    s = float((d * d).sum())
    z = (float((d[1:] * d[:-1]).sum()) / s + 1 / n) * math.sqrt(n) if s else math.sqrt(n)
    p.append(math.erfc(abs(z) / math.sqrt(2)))
    return chi2_tail(-2 * sum(math.log(max(x, 1e-300)) for x in p), 2 * len(p))


def length_class(n: int) -> int:
    return max(x for x in LENGTHS if x <= n)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, float]]:
    """(start, end, class, p-value) of the strings outside base findings."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if not (_DIGIT.search(token) and _LETTER.search(token)) or any(x[0] < m.end() and m.start() < x[2] for x in base):
            continue
        found = infer(token)
        if found and len(found[1]) >= LENGTHS[0]:
            out.append((m.start(), m.end(), f"{found[0]}/{length_class(len(found[1]))}", battery(found[1], len(ALPHABETS[found[0]]))))
    return out


def _threshold(counts: list[int], rate: float) -> float:
    random_per_bin = sum(counts[BINS // 2 :]) / (BINS - BINS // 2)
    above, best = 0, 2.0
    for k in range(BINS - 1, -1, -1):
        above += counts[k]
        if above and 1 - min(1.0, random_per_bin * (BINS - k) / above) <= rate:
            best = k / BINS
    return best


def thresholds(histogram: dict[str, list[int]], rate: float = RATE) -> dict[str, float]:
    """Least p-value of a finding, by class."""
    out = {}
    for name, counts in histogram.items():
        out[name] = _threshold(counts, rate)
        if sum(counts) >= ENOUGH:
            continue
        encoding, length = name.split("/")
        mine = LENGTHS.index(int(length))
        for reach in range(1, len(LENGTHS)):
            near = [histogram.get(f"{encoding}/{n}", [0] * BINS) for n in LENGTHS[max(0, mine - reach) : mine + reach + 1]]
            shared = [sum(x) for x in zip(*near)]
            if sum(shared) >= ENOUGH:
                out[name] = min(out[name], _threshold(shared, rate))
                break
        else:
            out[name] = min(out[name], rate)
    return out


_SCAN = "doc_id long, base array<struct<start:int,kind:int,stop:int,test:string>>, more array<struct<start:int,stop:int,name:string,p:double>>"


def _scan(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("test", pa.string())]))
    kind2 = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("name", pa.string()), ("p", pa.float64())]))
    for rows, _, _ in slices(batches):
        base, more = [], []
        for text in rows.column("text").to_pylist():
            b = base_spans(text)
            base.append([{"start": s, "kind": k, "stop": e, "test": tested(v)} for s, k, e, v in b])
            more.append([{"start": s, "stop": e, "name": n, "p": p} for s, e, n, p in candidates(text, b)])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(base, kind), pa.array(more, kind2)], names=["doc_id", "base", "more"])


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans and base_tests of every row."""
    found = cut(texts(docs).mapInArrow(_scan, _SCAN))
    binned = found.select(F.explode("more").alias("m")).groupBy("m.name", F.least(F.floor(F.col("m.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    histogram: dict[str, list[int]] = {}
    for r in binned.collect():  # classes x bins
        histogram.setdefault(r["name"], [0] * BINS)[r["bin"]] = r["count"]
    limit = thresholds(histogram, rate)

    def finish(batches):
        for rows in batches:
            counts, digest, spans, tests = [], [], [], []
            for base, more in zip(rows.column("base").to_pylist(), rows.column("more").to_pylist()):
                b = sorted((x["start"], x["kind"], x["stop"]) for x in base)
                r = [(x["start"], 3, x["stop"]) for x in more if x["p"] >= limit.get(x["name"], 2.0)]
                counts.append([*(sum(k == j for _, k, _ in b) for j in range(3)), len(r)])
                told = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x) for x in (b, sorted(b + r))]
                digest.append(hashlib.sha256(told[0].encode()).hexdigest())
                spans.append(told[1])
                tests.append(",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['stop']}:{x['test']}" for x in sorted(base, key=lambda x: (x["start"], x["kind"]))))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(n[:, j]) for j in range(4)), *(pa.array(x, pa.string()) for x in (digest, spans, tests))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "base_tests"])

    return found.mapInArrow(finish, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, base_tests string")
