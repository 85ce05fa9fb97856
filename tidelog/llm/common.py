"""Shared pieces: session helpers and whole-batch text primitives.

Text primitives work on the contiguous UTF-8 buffer of an Arrow batch, so a
word costs a few vector operations and never a Python object. Nulls are empty
texts everywhere in this subpackage.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once; one longer text is handled alone and whole.
SLICE_BYTES = 1 << 19
#: Rows and bytes that Spark hands to a Python worker at once; one longer row goes alone.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bound_batches(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a folder of
    this machine serves a local master, and anything else is an error, since executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:  # the setting itself cannot be changed while an application runs
            _local[app] = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        found = _local[app]
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage
    ends there, so a lost executor costs only the tasks it was running."""
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a frame made by :func:`cut`."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tidelog_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the JVM notice that finished jobs' shuffle files are no longer needed, so they leave the disks now."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the wanted other columns and the text; whatever else ``docs`` has is left out."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce("text", F.lit("")).alias("text"))


# ---------------------------------------------------------------- buffers


def buffer_of(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; offsets has one entry more than the array."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES):
    """(rows, bytes, offsets) of consecutive rows whose texts hold about ``limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.concatenate(([0], np.cumsum(size)[:-1])) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n]):
            rows = batch.slice(a, b - a)
            yield rows, *buffer_of(rows.column(column))


# ---------------------------------------------------------------- hashing

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_TAB = np.random.default_rng(20240115).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A Mersenne prime; sums modulo 2^64 alone make strings of a doubling pattern collide.
_P = (1 << 31) - 1
_C = 0x4E1F2A6D
_SIZE = 0xD6E8FEB86659FD93
_TAB31 = np.random.default_rng(20240116).integers(1, _P, 256, dtype=np.uint64)
_MASK31, _31 = np.uint64(_P), np.uint64(31)
#: Powers up to here are kept between calls; longer texts make theirs anew.
KEPT_POWERS = 1 << 21
_pow: dict[str, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo the prime, 31 bits shorter but for a carry."""
    low = x & _MASK31
    low += x >> _31
    return low


def _powers(n: int, which: str) -> np.ndarray:
    have = _pow.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        if which in "bi":
            have = np.full(size, _B if which == "b" else _BI, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        else:
            base, have = (_C if which == "c" else pow(_C, -1, _P)), np.ones(1, np.uint64)
            while len(have) < size:
                have = np.concatenate((have, _fold(_fold(have * np.uint64(pow(base, len(have), _P))))))
        if size <= KEPT_POWERS:
            _pow[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums modulo 2^64 and a prime, one more than the bytes; feeds :func:`span_hash`."""
    n = len(buf)
    out, odd = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(_TAB[buf] * _powers(n, "b"), out=out[1:])
    np.cumsum(_fold(_TAB31[buf] * _powers(n, "c")), out=odd[1:])
    return out, odd


def _joined(h: np.ndarray, r: np.ndarray, length) -> np.ndarray:
    r = _fold(_fold(r))
    r -= _MASK31 * (r >= _MASK31)
    r *= np.uint64(0xA24BAED4963EE407)
    r ^= h + length
    return mix(r)


def span_hash(pre: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand. They
    route and sort; where equality decides a result, bytes are compared (:func:`exact`)."""
    a, b = pre
    n = len(a)
    h = (a[ends] - a[starts]) * _powers(n, "i")[starts]
    r = _fold(b[ends] - b[starts]) * _powers(n, "j")[starts]
    return _joined(h, r, (ends - starts).astype(np.uint64) * np.uint64(_SIZE))


def even_hash(pre: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """:func:`span_hash` of every k consecutive bytes."""
    a, b = pre
    n = len(a) - k
    h = (a[k:] - a[:n]) * _powers(len(a), "i")[:n]
    r = _fold(b[k:] - b[:n]) * _powers(len(a), "j")[:n]
    return _joined(h, r, np.uint64(k * _SIZE & (1 << 64) - 1))


#: Spans compared at once, and bytes from which a pair is compared on its own.
_PAIRS, _LONG = 1 << 20, 512


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size[k]`` bytes from ``a[k]`` and from ``b[k]`` are equal, for every k; eight bytes at a step."""
    out = np.ones(len(a), bool)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    for at in range(0, len(a), _PAIRS):
        left = np.arange(at, min(at + _PAIRS, len(a)))
        x, y, n = a[left], b[left], size[left]
        while len(left):
            part = np.minimum(n, 8)
            mask = np.where(part == 8, ~np.uint64(0), (np.uint64(1) << (8 * np.minimum(part, 7)).astype(np.uint64)) - np.uint64(1))
            same = ((eight[x] ^ eight[y]) & mask) == 0
            out[left[~same]] = False
            go = same & (n > 8)
            left, x, y, n = left[go], x[go] + 8, y[go] + 8, n[go] - 8
            far = n > _LONG
            if far.any():
                for k, p, q, m in zip(left[far].tolist(), x[far].tolist(), y[far].tolist(), n[far].tolist()):
                    out[k] = np.array_equal(buf[p : p + m], buf[q : q + m])
                left, x, y, n = left[~far], x[~far], y[~far], n[~far]
    return out


def exact(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's class of equal bytes, the first span of each class), by hash and then byte by byte."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    s, size, g = starts[order], (ends - starts)[order], h[order]
    tied = np.flatnonzero(g[1:] == g[:-1]) + 1
    new = np.ones(n, bool)
    new[tied] = False
    same = size[tied] == size[tied - 1]
    same[same] = same_bytes(buf, s[tied[same] - 1], s[tied[same]], size[tied[same]])
    number = np.cumsum(new) - 1
    first = order[new]
    if not same.all():
        # different bytes under one hash: the members of such a class are told apart one by one
        first = first.tolist()
        for c in np.unique(number[tied[~same]]).tolist():
            known: dict[bytes, int] = {}
            for k in np.flatnonzero(number == c).tolist():
                data = buf[s[k] : s[k] + size[k]].tobytes()
                if data not in known:
                    known[data] = c if not known else len(first)
                    if known[data] == len(first):
                        first.append(order[k])
                number[k] = known[data]
        first = np.array(first, np.int64)
    out = np.empty(n, np.int64)
    out[order] = number
    return out, first


# ---------------------------------------------------------------- words

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte spans, hashes, and where each document's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  #: index of the first word of each document, one entry more
    buf: np.ndarray
    hash: np.ndarray = field(default=None)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, one word of each number): equal numbers are equal words."""
        return exact(self.buf, self.starts, self.ends, self.hash)


def words(buf: np.ndarray, off: np.ndarray, hashed: bool = True) -> Words:
    is_word = ~_WS[buf]
    begin = is_word.copy()
    finish = is_word.copy()
    if len(buf):
        begin[1:] &= ~is_word[:-1]
        finish[:-1] &= ~is_word[1:]
        edge = off[1:-1]
        inside = edge[(edge > 0) & (edge < len(buf))]
        begin[inside] = is_word[inside]
        finish[inside - 1] = is_word[inside - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(starts, off).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(starts, ends, doc, first, buf, span_hash(prefix_hash(buf), starts, ends) if hashed else None)


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive word hashes, document edges ignored."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : k + m]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    if w == 1:
        return x.copy()
    pad = -n % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate((x, np.full(pad, top, x.dtype))).reshape(-1, w)
    fore = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.subtract.at(d, ends, 1)
    return np.cumsum(d[:-1]) > 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = [x for x in dir() if not x.startswith("_")]
