"""Byte codecs and predicates as Column expressions; all stay inside whole-stage codegen unless said otherwise."""

from __future__ import annotations

import functools
import math
import zlib

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DELETE, POINTER_SIZE, RESERVED_PREFIX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_bytes(x: bytes) -> Column:
    return F.lit(bytearray(x))


# ------------------------------------------------------------ internal keys


def key_with_ts(key="user_key", ts="version") -> Column:
    """user key, then 8 bytes that fall as the version rises: plain byte order is key ascending, version descending."""
    return F.concat(_c(key), F.unhex(F.hex(F.bitwise_not(_c(ts)))))


def key_first(key="user_key") -> Column:
    """Before every version of a key."""
    return F.concat(_c(key), lit_bytes(bytes(8)))


def key_last(key="user_key") -> Column:
    """Behind every version of a key."""
    return F.concat(_c(key), lit_bytes(b"\xff" * 8))


def user_key(internal="internal_key") -> Column:
    k = _c(internal)
    return F.substring(k, F.lit(1), F.octet_length(k) - 8)


def version_of(internal="internal_key") -> Column:
    tail = F.hex(F.substring(_c(internal), -8, 8))
    return F.bitwise_not(F.conv(tail, 16, -10).cast("long"))


def same_key(a, b) -> Column:
    """Whether two internal keys hold one user key."""
    return user_key(a) == user_key(b)


# ------------------------------------------------------------ predicates


def visible(ts: int, version="version") -> Column:
    return _c(version) <= F.lit(ts)


def dead(now_ms: int, meta="meta", expires_at="expires_at") -> Column:
    """Deleted, or past its time; 0 never expires."""
    e = _c(expires_at)
    return (_c(meta).bitwiseAND(DELETE) != 0) | ((e != 0) & (e <= F.lit(now_ms)))


def absent(value="value", meta="meta") -> Column:
    return (F.octet_length(_c(value)) == 0) & (_c(meta) == 0)


def internal(key="user_key", prefix: bytes = RESERVED_PREFIX) -> Column:
    return has_prefix(key, prefix)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; none if there is no such key."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def has_prefix(key, prefix: bytes) -> Column:
    """Prefix test as a range, which reaches Parquet statistics; startswith on bytes would not."""
    k, end = _c(key), prefix_end(prefix)
    out = k >= lit_bytes(prefix)
    return out & (k < lit_bytes(end)) if end is not None else out


def has_any_prefix(key, prefixes: list[bytes]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | has_prefix(key, p)
    return out


def separated(threshold: int, value="value") -> Column:
    """Whether a value is stored apart; a threshold of 0 separates nothing."""
    return F.octet_length(_c(value)) >= threshold if threshold else F.lit(False)


def estimate_size(threshold: int, key="user_key", value="value") -> Column:
    size = F.octet_length(_c(value))
    return (F.octet_length(_c(key)) + F.when(size < threshold, size).otherwise(POINTER_SIZE) + 2).cast("long")


# ------------------------------------------------------------ values, pointers, headers


def _byte(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.bitwiseAND(255)), 2, "0"))


def varint(c) -> Column:
    """Little-endian base-128 bytes of a non-negative long."""
    c = _c(c)
    out = _byte(F.when(c > 127, c.bitwiseAND(127).bitwiseOR(128)).otherwise(c))
    for k in range(1, 9):
        rest = F.shiftright(c, 7 * k)
        piece = _byte(F.when(rest > 127, rest.bitwiseAND(127).bitwiseOR(128)).otherwise(rest))
        out = F.concat(out, F.when(rest > 0, piece).otherwise(lit_bytes(b"")))
    return out


def varint_size(c) -> Column:
    c = _c(c)
    out = F.lit(1)
    for k in range(1, 9):
        out = out + F.when(F.shiftright(c, 7 * k) > 0, 1).otherwise(0)
    return out


def _at(b: Column, k) -> Column:
    return F.conv(F.hex(F.substring(b, k if isinstance(k, Column) else F.lit(k), F.lit(1))), 16, 10).cast("long")


def read_varint(b, start: int = 1) -> tuple[Column, Column]:
    """(value, bytes used) of the varint at a 1-based place."""
    b = _c(b)
    value, used, going = F.lit(0).cast("long"), F.lit(0), F.lit(True)
    for k in range(9):
        x = _at(b, start + k)
        value = value + F.when(going, F.shiftleft(x.bitwiseAND(127), 7 * k)).otherwise(0)
        used = used + F.when(going, 1).otherwise(0)
        going = going & (x > 127)
    return value, used


def encode_value(meta="meta", user_meta="user_meta", expires_at="expires_at", value="value") -> Column:
    """meta, user_meta, expires_at as a varint, then the payload."""
    return F.concat(_byte(_c(meta)), _byte(_c(user_meta)), varint(expires_at), _c(value))


def encoded_size(expires_at="expires_at", value="value") -> Column:
    return F.lit(2) + varint_size(expires_at) + F.octet_length(_c(value))


def decode_value(cell="cell") -> Column:
    """Struct of meta, user_meta, expires_at and value."""
    b = _c(cell)
    expires, used = read_varint(b, 3)
    rest = F.substring(b, F.lit(3) + used, F.octet_length(b))
    return F.struct(_at(b, 1).cast("int").alias("meta"), _at(b, 2).cast("int").alias("user_meta"), expires.alias("expires_at"), rest.alias("value"))


def _le32(c: Column) -> Column:
    return F.concat(*(_byte(F.shiftright(c, 8 * k)) for k in range(4)))


def encode_pointer(ref="value_ref") -> Column:
    """file_id, len and offset, four little-endian bytes each."""
    r = _c(ref)
    return F.concat(*(_le32(r[k].cast("long")) for k in ("file_id", "len", "offset")))


def decode_pointer(b="pointer") -> Column:
    b = _c(b)

    def word(start):
        out = F.lit(0).cast("long")
        for k in range(4):
            out = out + F.shiftleft(_at(b, start + k), 8 * k)
        return out.cast("int")

    return F.struct(word(1).alias("file_id"), word(5).alias("len"), word(9).alias("offset"))


def encode_log_entry(key="user_key", meta="meta", user_meta="user_meta", expires_at="expires_at", value="value") -> Column:
    """A log record: key and value lengths and expiry as varints, two flag bytes, key, value."""
    return F.concat(varint(F.octet_length(_c(key)).cast("long")), varint(F.octet_length(_c(value)).cast("long")), varint(expires_at), _byte(_c(meta)), _byte(_c(user_meta)), _c(key), _c(value))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def decode_log_entry(record="record") -> Column:
    def lengths(b):
        """Key length, value length, expiry, and the bytes behind them."""

        def step(tail, then):
            n, used = read_varint(tail, 1)
            return _let(F.struct(n.alias("n"), F.substring(tail, F.lit(1) + used, F.octet_length(tail)).alias("tail")), then)

        return step(b, lambda k: step(k["tail"], lambda v: step(v["tail"], lambda e: F.struct(k["n"].cast("int").alias("k"), v["n"].cast("int").alias("v"), e["n"].alias("e"), e["tail"].alias("tail")))))

    def fields(x):
        t = x["tail"]
        return F.struct(F.substring(t, F.lit(3), x["k"]).alias("user_key"), _at(t, 1).cast("int").alias("meta"), _at(t, 2).cast("int").alias("user_meta"), x["e"].alias("expires_at"), F.substring(t, F.lit(3) + x["k"], x["v"]).alias("value"))

    return _let(lengths(_c(record)), fields)


def bytes_diff(base, target) -> Column:
    """What of ``target`` follows the prefix it shares with ``base``."""
    b, t = _c(base), _c(target)
    steps = F.sequence(F.lit(0), F.least(F.octet_length(b), F.octet_length(t)))
    same = F.aggregate(steps, F.lit(0), lambda acc, i: F.when((i > 0) & (acc == i - 1) & (F.substring(b, i, F.lit(1)) == F.substring(t, i, F.lit(1))), i).otherwise(acc))
    return F.substring(t, same + 1, F.octet_length(t))


# ------------------------------------------------------------ checksums and filters


def crc32(c) -> Column:
    """IEEE CRC-32 as an unsigned number."""
    return F.crc32(_c(c))


def xxh64(c) -> Column:
    """xxHash64 with seed 0 as a signed long, null for null: Spark's own expression, whose function
    in the Python API has another seed."""
    col = _c(c)
    jvm = SparkContext._active_spark_context._jvm
    tools = jvm.org.apache.spark.sql.classic.ExpressionUtils
    children = jvm.PythonUtils.toSeq([tools.expression(col._jc)])
    hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(children, jvm.java.lang.Long(0))
    return F.when(col.isNotNull(), Column(tools.column(hashed)))


def crc32_of(data: bytes) -> int:
    return zlib.crc32(data)


_CASTAGNOLI = 0x82F63B78  # reversed polynomial


@functools.cache
def _crc32c_table() -> tuple[int, ...]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return tuple(out)


def crc32c_of(data: bytes) -> int:
    """CRC-32C on the driver, for commit records."""
    table, crc = _crc32c_table(), 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def bloom_options(fpp: float, column: str = "user_key") -> dict[str, str]:
    """Parquet writer options for a key filter; none at a rate of 0 or less."""
    if fpp <= 0:
        return {}
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.fpp#{column}": str(fpp)}


def bloom_bits_per_key(entries: int, fpp: float) -> int:
    """Bits a key that a filter of ``entries`` keys needs for a rate of false positives."""
    return math.ceil(-math.log(fpp) / math.log(2) ** 2) if entries and 0 < fpp < 1 else 0
