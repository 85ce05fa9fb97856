"""The registered queries of the entry log and the same questions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model as M
from .functions import codec as C
from .operators import conflicts, history, ranges, retention, scan, snapshot
from .plans import compaction
from .sources import datasets as D
from .sources.files import scratch
from .sources.manifest import replay
from .store import Entry, KVStore
from .streaming.ingest import change_feed

KEEP, NOW, LIMIT, THRESHOLD = 3, 1_705_320_000_000, 10, 1024
#: Snapshots are read at half of the greatest version, compactions discard up to a third of it.
AS_OF, DISCARD = (f"(SELECT max(version) // {k} FROM kv)" for k in (2, 3))
PREFIX, SEEK, SEEK_BACK, GET = b"u00001", b"u000050", b"u000049", b"u000042"
PROBES = ["a", "u000000", "u0000105", "u000050", "u000149", "zz"]
BLOCK_ROWS, FILE_ROWS, SPLITS = 100, 1000, 4

def as_of(df: DataFrame, part: int = 2) -> int:
    """The greatest version of the entries, divided: one column is read for it."""
    return (df.agg(F.max("version")).first()[0] or 0) // part


def discard(df: DataFrame) -> int:
    return as_of(df, 3)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_TEXT = {"user_key", "value", "smallest", "biggest", "probe", "found", "first_key", "last_key", "core", "old_value"}


def told(df: DataFrame) -> DataFrame:
    """Keys and values as text."""
    return df.select(*(F.decode(c, "UTF-8").alias(c) if c in _TEXT and t == "binary" else F.col(c) for c, t in df.dtypes))


EVENTS = """kv AS (SELECT printf('u%06d', user_id) AS user_key, event_id + 1 AS version,
  CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 4 ELSE 0 END AS meta, (event_id % 256)::INT AS user_meta,
  CASE WHEN event_type = 'view' THEN epoch_us(ts) // 1000 + 604800000 ELSE 0 END AS expires_at, props AS value FROM events)"""
ORDERS = """kv AS (SELECT printf('c%08d', o_custkey) AS user_key, o_orderkey + 1 AS version, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS meta,
  0 AS user_meta, 0::BIGINT AS expires_at, o_orderpriority AS value FROM orders)"""
LINES = """kv AS (SELECT printf('o%010d', l_orderkey) AS user_key, l_linenumber::BIGINT AS version, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS meta,
  0 AS user_meta, 0::BIGINT AS expires_at, l_linestatus AS value, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus FROM lineitem)"""
DOCS = "kv AS (SELECT printf('d%08d', doc_id) AS user_key, 1::BIGINT AS version, 0 AS meta, 0 AS user_meta, 0::BIGINT AS expires_at, coalesce(text, '') AS value FROM documents)"
COLS = "user_key, version, meta, user_meta, expires_at, value"
DEAD = f"((meta & 1) <> 0 OR (expires_at <> 0 AND expires_at <= {NOW}))"


def _latest(source: str = "kv", ts: str = AS_OF, cond: str = "TRUE") -> str:
    return f"s AS (SELECT {COLS}, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS rn FROM {source} WHERE version <= {ts} AND {cond}), l AS (SELECT {COLS} FROM s WHERE rn = 1)"


def query(sql: str | None = None, base: str = EVENTS):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {base}, {sql}" if not sql.startswith("SELECT") else f"WITH {base} {sql}"
        return f

    return add


# ------------------------------------------------------------ reads


@query(f"SELECT {COLS} FROM kv WHERE user_key = 'u000042' AND version <= {AS_OF} ORDER BY version DESC LIMIT 1")
def raw_get(spark: SparkSession, sf: str) -> DataFrame:
    return told(scan.raw_get(kv := D.kv_events(spark, sf), GET, as_of(kv)))


@query(f"g AS (SELECT {COLS} FROM kv WHERE user_key = 'u000042' AND version <= {AS_OF} ORDER BY version DESC LIMIT 1) SELECT * FROM g WHERE NOT {DEAD}")
def point_get(spark, sf):
    return told(scan.point_get(kv := D.kv_events(spark, sf), GET, as_of(kv), NOW))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD} AND user_key IN (SELECT printf('c%08d', c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')".replace("s AS", "s AS", 1), ORDERS)
def multi_get(spark, sf):
    keys = D.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.encode(F.format_string("c%08d", "c_custkey"), "UTF-8").alias("user_key"))
    return told(scan.get_many(kv := D.kv_orders(spark, sf), keys, as_of(kv), NOW))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD}")
def scan_asof(spark, sf):
    return told(scan.scan(kv := D.kv_events(spark, sf), as_of(kv), NOW))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD}")
def scan_reverse(spark, sf):
    return told(scan.scan(kv := D.kv_events(spark, sf), as_of(kv), NOW, reverse=True))


@query(f"SELECT {COLS} FROM kv WHERE version <= {AS_OF}")
def scan_all_versions(spark, sf):
    return told(scan.all_versions(kv := D.kv_events(spark, sf), as_of(kv)))


@query(f"SELECT {COLS} FROM kv WHERE version <= {AS_OF}")
def scan_all_versions_rev(spark, sf):
    return told(scan.all_versions(kv := D.kv_events(spark, sf), as_of(kv), reverse=True))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD} AND user_key >= 'u000050' ORDER BY user_key LIMIT {LIMIT}")
def seek_forward(spark, sf):
    return told(scan.seek(kv := D.kv_events(spark, sf), SEEK, as_of(kv), NOW, limit=LIMIT))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD} AND user_key <= 'u000049' ORDER BY user_key DESC LIMIT {LIMIT}")
def seek_reverse(spark, sf):
    return told(scan.seek(kv := D.kv_events(spark, sf), SEEK_BACK, as_of(kv), NOW, reverse=True, limit=LIMIT))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD} ORDER BY user_key LIMIT {LIMIT}")
def limit_scan(spark, sf):
    return told(scan.seek(kv := D.kv_events(spark, sf), b"", as_of(kv), NOW, limit=LIMIT))


@query(f"{_latest()} SELECT min(user_key) AS first_key, max(user_key) AS last_key FROM l WHERE NOT {DEAD}")
def first_last(spark, sf):
    return told(scan.first_last(snapshot.as_of(kv := D.kv_events(spark, sf), as_of(kv), NOW)))


@query(f"{_latest(cond=chr(115) + 'tarts_with(user_key, ' + chr(39) + 'u00001' + chr(39) + ')')} SELECT * FROM l WHERE NOT {DEAD}")
def prefix_scan(spark, sf):
    return told(scan.prefix_scan(kv := D.kv_events(spark, sf), PREFIX, as_of(kv), NOW))


def _nearest(kind: str):
    op, pick = {"gt": (">", "min"), "ge": (">=", "min"), "lt": ("<", "max"), "le": ("<=", "max")}[kind]
    probes = " UNION ALL ".join(f"SELECT '{p}' AS probe" for p in PROBES)

    def run(spark, sf):
        return told(scan.nearest(D.kv_events(spark, sf), [p.encode() for p in PROBES], kind))

    QUERIES[f"nearest_{kind}"] = run
    ORACLES[f"nearest_{kind}"] = f"WITH {EVENTS}, p AS ({probes}) SELECT probe, (SELECT {pick}(user_key) FROM kv WHERE user_key {op} probe) AS found FROM p"


for _k in ("gt", "ge", "lt", "le"):
    _nearest(_k)


@query(f"SELECT min(version) AS version FROM kv WHERE version * 3 >= (SELECT max(version) FROM kv)")
def search_bound(spark, sf):
    return scan.search(kv := D.kv_events(spark, sf), "version", F.col("version") * 3 >= as_of(kv, 1))


# ------------------------------------------------------------ predicates


@query(f"SELECT {COLS} FROM kv WHERE version <= {AS_OF}")
def visible_versions(spark, sf):
    return told((kv := D.kv_events(spark, sf)).where(C.visible(as_of(kv))))


@query(f"SELECT {COLS} FROM kv WHERE (meta & 1) <> 0")
def tombstones(spark, sf):
    return told(D.kv_events(spark, sf).where(F.col("meta").bitwiseAND(M.DELETE) != 0))


@query(f"SELECT {COLS} FROM kv WHERE expires_at <> 0 AND expires_at <= {NOW}")
def expired_keys(spark, sf):
    return told(D.kv_events(spark, sf).where((F.col("expires_at") != 0) & (F.col("expires_at") <= NOW)))


@query(f"SELECT {COLS} FROM kv WHERE NOT {DEAD}")
def ttl_scan(spark, sf):
    return told(snapshot.live(D.kv_events(spark, sf), NOW))


def _with_empty(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("version") % 10 == 0, F.lit(bytearray(b""))).otherwise(F.col("value")))


@query("e AS (SELECT user_key, version, meta, user_meta, expires_at, CASE WHEN version % 10 = 0 THEN '' ELSE value END AS value FROM kv) SELECT * FROM e WHERE strlen(value) = 0 AND meta = 0")
def empty_values(spark, sf):
    return told(_with_empty(D.kv_events(spark, sf)).where(C.absent()))


def _with_internal(df: DataFrame) -> DataFrame:
    return df.withColumn("user_key", F.when(F.col("version") % 7 == 0, F.concat(C.lit_bytes(M.RESERVED_PREFIX), F.col("user_key"))).otherwise(F.col("user_key")))


_INTERNAL = "k2 AS (SELECT CASE WHEN version % 7 = 0 THEN '!tide!' || user_key ELSE user_key END AS user_key, version, meta, user_meta, expires_at, value FROM kv)"


@query(f"{_INTERNAL}, {_latest('k2')} SELECT * FROM l WHERE NOT {DEAD}")
def internal_keys(spark, sf):
    return told(scan.scan(_with_internal(kv := D.kv_events(spark, sf)), as_of(kv), NOW, internal_access=True))


@query(f"{_INTERNAL}, {_latest('k2')} SELECT * FROM l WHERE NOT {DEAD} AND NOT starts_with(user_key, '!tide!')")
def internal_hidden(spark, sf):
    return told(scan.scan(_with_internal(kv := D.kv_events(spark, sf)), as_of(kv), NOW))


# ------------------------------------------------------------ merge and overlay


def _pending(spark, sf):
    """Uncommitted writes: orders' customers as users; every third one a delete."""
    o = D.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 150).alias("u")).agg(F.max("o_orderkey").alias("k"))
    gone = F.col("u") % 3 == 0
    return o.select(F.encode(F.format_string("u%06d", "u"), "UTF-8").alias("user_key"), F.lit(0).cast("long").alias("version"), F.when(gone, 1).otherwise(0).alias("meta"), F.lit(0).alias("user_meta"), F.lit(0).cast("long").alias("expires_at"), F.encode(F.when(gone, "").otherwise(F.concat(F.lit("w"), F.col("k").cast("string"))), "UTF-8").alias("value"))


_PENDING = f"""o AS (SELECT o_custkey % 150 AS u, max(o_orderkey) AS k FROM orders GROUP BY 1),
p AS (SELECT printf('u%06d', u) AS user_key, {AS_OF}::BIGINT AS version, CASE WHEN u % 3 = 0 THEN 1 ELSE 0 END AS meta, 0 AS user_meta, 0::BIGINT AS expires_at, CASE WHEN u % 3 = 0 THEN '' ELSE 'w' || k END AS value, -1 AS prio FROM o),
a AS (SELECT {COLS}, prio FROM p UNION ALL SELECT {COLS}, 0 FROM kv WHERE version <= {AS_OF}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC, prio) AS rn FROM a)"""


@query(f"{_PENDING} SELECT {COLS} FROM r WHERE rn = 1 AND NOT {DEAD}")
def read_your_writes(spark, sf):
    return told(snapshot.read_your_writes(kv := D.kv_events(spark, sf), _pending(spark, sf), as_of(kv), NOW))


def _sources(spark, sf):
    """Three overlapping sources: all entries, every second one with another value, every third with a third."""
    kv = D.kv_events(spark, sf)

    def marked(mark):
        return F.concat(C.lit_bytes(mark), F.col("value"))

    return [kv.where("version % 3 = 0").withColumn("value", marked(b"c")), kv.where("version % 2 = 0").withColumn("value", marked(b"b")), kv]


@query(f"SELECT user_key, version, meta, user_meta, expires_at, CASE WHEN version % 3 = 0 THEN 'c' || value WHEN version % 2 = 0 THEN 'b' || value ELSE value END AS value FROM kv")
def merge_sources(spark, sf):
    return told(snapshot.merge(_sources(spark, sf)))


_BY = ", ".join(D.LINE_PRIORITY)


@query(f"r AS (SELECT *, row_number() OVER (PARTITION BY user_key, version ORDER BY {_BY}) AS rn FROM kv) SELECT {COLS}, l_partkey FROM r WHERE rn = 1", LINES)
def merge_dedupe(spark, sf):
    return told(snapshot.first_wins(D.kv_lineitem(spark, sf), *D.LINE_PRIORITY).select(*M.COLUMNS, "l_partkey"))


@query(f"r AS (SELECT *, row_number() OVER (PARTITION BY user_key, version ORDER BY {', '.join(x + ' DESC' for x in D.LINE_PRIORITY)}) AS rn FROM kv) SELECT {COLS}, l_partkey FROM r WHERE rn = 1", LINES)
def first_write_wins(spark, sf):
    return told(snapshot.first_wins(D.kv_lineitem(spark, sf), *(F.desc(c) for c in D.LINE_PRIORITY)).select(*M.COLUMNS, "l_partkey"))


@query(f"SELECT {COLS} FROM kv UNION ALL SELECT printf('c%08d', o_custkey), o_orderkey + 1, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, 0, 0::BIGINT, o_orderpriority FROM orders")
def concat_runs(spark, sf):
    return told(snapshot.concat([D.kv_events(spark, sf), D.kv_orders(spark, sf)]))


@query(f"SELECT {COLS} FROM kv")
def log_replay(spark, sf):
    """Entries through the log's record format and back."""
    records = D.kv_events(spark, sf).select("version", C.encode_log_entry().alias("record"))
    e = records.select("version", C.decode_log_entry().alias("e"))
    return told(e.select(F.col("e.user_key").alias("user_key"), "version", "e.meta", "e.user_meta", "e.expires_at", F.col("e.value").alias("value")))


# ------------------------------------------------------------ retention


def _retain_sql(upto: int | str, keep: int, overlap: bool, source: str = "kv") -> str:
    w = "PARTITION BY user_key ORDER BY version DESC"
    return f"""f AS (SELECT *, version <= {upto} AND (meta & 8) = 0 AS counted, {DEAD} AS gone FROM {source}),
n AS (SELECT *, sum(counted::INT) OVER ({w} ROWS UNBOUNDED PRECEDING) AS n FROM f),
x AS (SELECT *, counted AND (gone OR (meta & 4) <> 0 OR n = {keep}) AS stop FROM n),
y AS (SELECT *, coalesce(max(stop::INT) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM x)
SELECT {COLS} FROM y WHERE past = 0{'' if overlap else ' AND NOT (counted AND gone)'}"""


def _retention(name: str, upto: int | str, keep: int, overlap: bool):
    def run(spark, sf):
        kv = D.kv_events(spark, sf)
        return told(retention.retain(kv, discard(kv) if upto == DISCARD else upto, keep, NOW, overlap))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {EVENTS}, {_retain_sql(upto, keep, overlap)}"


_retention("compact_keep1", M.MAX_VERSION, 1, False)
_retention("compact_keepN", M.MAX_VERSION, KEEP, False)
_retention("compact_discard_ts", DISCARD, 1, False)
_retention("compact_overlap", DISCARD, KEEP, True)
_retention("discard_earlier", M.MAX_VERSION, M.KEEP_ALL, True)


@query(_retain_sql(DISCARD, KEEP, False))
def compact_hot_keys(spark, sf):
    return told(retention.retain_hot(kv := D.kv_events(spark, sf), discard(kv), KEEP, NOW, False))


@query("m AS (SELECT user_key, version, meta + CASE WHEN version % 5 = 0 THEN 8 ELSE 0 END AS meta, user_meta, expires_at, value FROM kv), " + _retain_sql(DISCARD, 2, True, "m"))
def merge_entries(spark, sf):
    df = D.kv_events(spark, sf).withColumn("meta", F.col("meta") + F.when(F.col("version") % 5 == 0, M.MERGE_ENTRY).otherwise(0))
    return told(retention.retain(df, discard(df), 2, NOW, True))


@query(f"r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS rn FROM kv) SELECT {COLS} FROM r WHERE rn <= {KEEP}")
def latest_n_versions(spark, sf):
    return told(retention.latest_versions(D.kv_events(spark, sf), KEEP))


@query(f"SELECT {COLS} FROM kv WHERE NOT starts_with(user_key, 'u00001') AND NOT starts_with(user_key, 'u00010')")
def drop_prefixes(spark, sf):
    return told(retention.drop_prefixes(D.kv_events(spark, sf), [b"u00001", b"u00010"]))


# ------------------------------------------------------------ values and codecs


@query(f"SELECT user_key, strlen(value)::INT AS value_len, strlen(value) >= {THRESHOLD} AS separated FROM kv", DOCS)
def value_separation(spark, sf):
    return told(D.kv_docs(spark, sf).select("user_key", F.octet_length("value").alias("value_len"), C.separated(THRESHOLD).alias("separated")))


@query(f"SELECT user_key, version, CASE WHEN strlen(value) >= {THRESHOLD} THEN 2 ELSE 0 END AS meta, value FROM kv", DOCS)
def value_resolve(spark, sf):
    kept, blobs = snapshot.separate_values(D.kv_docs(spark, sf), THRESHOLD, 1)
    return told(snapshot.resolve_values(kept, blobs).select("user_key", "version", "meta", "value"))


@query(f"SELECT user_key, (strlen(user_key) + CASE WHEN strlen(value) < {THRESHOLD} THEN strlen(value) ELSE 12 END + 2)::BIGINT AS estimated FROM kv", DOCS)
def estimate_size(spark, sf):
    return told(D.kv_docs(spark, sf).select("user_key", C.estimate_size(THRESHOLD).alias("estimated")))


@query(f"SELECT user_key, version, lower(hex(encode(user_key))) || printf('%016x', 18446744073709551615::HUGEINT - version) AS internal_key FROM kv")
def encode_internal_key(spark, sf):
    return told(D.kv_events(spark, sf).select("user_key", "version", F.lower(F.hex(C.key_with_ts())).alias("internal_key")))


@query("SELECT user_key, version FROM kv")
def decode_internal_key(spark, sf):
    k = D.kv_events(spark, sf).select(C.key_with_ts().alias("internal_key"))
    return told(k.select(C.user_key().alias("user_key"), C.version_of().alias("version")))


@query("SELECT DISTINCT lower(hex(encode(user_key))) || '0000000000000000' AS lo, lower(hex(encode(user_key))) || 'ffffffffffffffff' AS hi FROM kv")
def key_bounds(spark, sf):
    return D.kv_events(spark, sf).select(F.lower(F.hex(C.key_first())).alias("lo"), F.lower(F.hex(C.key_last())).alias("hi")).distinct()


@query("SELECT user_key, version, meta, user_meta, expires_at, value FROM kv")
def value_codec(spark, sf):
    cells = D.kv_events(spark, sf).select("user_key", "version", C.encode_value().alias("cell")).withColumn("v", C.decode_value())
    return told(cells.select("user_key", "version", F.col("v.meta").alias("meta"), F.col("v.user_meta").alias("user_meta"), F.col("v.expires_at").alias("expires_at"), F.col("v.value").alias("value")))


@query("SELECT version, (version % 1000)::INT AS file_id, meta AS len, (user_meta * 7)::INT AS offset_ FROM kv")
def pointer_codec(spark, sf):
    ref = F.struct((F.col("version") % 1000).cast("int").alias("file_id"), F.col("meta").alias("len"), (F.col("user_meta") * 7).cast("int").alias("offset"))
    p = D.kv_events(spark, sf).select("version", ref.alias("value_ref")).select("version", C.encode_pointer().alias("pointer")).withColumn("r", C.decode_pointer())
    return p.select("version", F.col("r.file_id").alias("file_id"), F.col("r.len").alias("len"), F.col("r.offset").alias("offset_"))


@query("SELECT version, CASE WHEN value LIKE '{\"%' THEN substr(value, 3) WHEN value LIKE '{%' THEN substr(value, 2) ELSE value END AS core FROM kv")
def bytes_diff(spark, sf):
    return told(D.kv_events(spark, sf).select("version", C.bytes_diff(C.lit_bytes(b'{"'), "value").alias("core")))


#: CRC-32 by its rule: the remainders of all bytes, then one step a byte.
_CRC = """t AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n))),
b AS (SELECT user_key, version, list_transform(range(strlen(value)), lambda i: ('0x' || substr(hex(encode(value)), (2 * i + 1)::INT, 2))::BIGINT) AS bytes FROM kv)"""


@query(f"{_CRC} SELECT user_key, version, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS crc FROM b, t")
def crc32_values(spark, sf):
    return told(D.kv_events(spark, sf).select("user_key", "version", C.crc32("value").alias("crc")))


@query()
def xxh64_values(spark, sf):
    return told(D.kv_events(spark, sf).select("user_key", "version", C.xxh64("value").alias("hash")))


# ------------------------------------------------------------ files and ranges


def _files(spark, sf):
    kv = D.kv_events(spark, sf).withColumn("file_id", F.floor(F.col("version") / FILE_ROWS).cast("long"))
    return kv, ranges.file_key_ranges(kv)


_FILES = f"fk AS (SELECT *, version // {FILE_ROWS} AS file_id FROM kv), fl AS (SELECT file_id, min(user_key) AS smallest, max(user_key) AS biggest, min(version) AS min_version, max(version) AS max_version, count(*) AS n_rows FROM fk GROUP BY file_id)"


@query(f"{_FILES} SELECT * FROM fl")
def file_key_ranges(spark, sf):
    return told(_files(spark, sf)[1])


@query(f"{_FILES} SELECT file_id, count(*) AS entries, sum(strlen(user_key) + strlen(value))::BIGINT AS bytes, sum(CASE WHEN (meta & 1) <> 0 THEN 1 ELSE 0 END)::BIGINT AS tombstones FROM fk GROUP BY file_id")
def file_stats(spark, sf):
    kv, _ = _files(spark, sf)
    return kv.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("user_key") + F.octet_length("value")).cast("long").alias("bytes"), F.count(F.when(F.col("meta").bitwiseAND(1) != 0, 1)).alias("tombstones"))


def _two_layouts(spark, sf):
    """Every second entry in files by age, whose key ranges overlap, the others in files by key, whose ranges do not."""
    e = D.kv_events(spark, sf)
    user = F.decode("user_key", "UTF-8").substr(2, 6).cast("long")
    return ranges.file_key_ranges(e.withColumn("file_id", F.when(F.col("version") % 2 == 0, F.floor(F.col("version") / FILE_ROWS)).otherwise(1_000_000 + F.floor(user / 10)).cast("long")))


_TWO = f"fk AS (SELECT *, CASE WHEN version % 2 = 0 THEN version // {FILE_ROWS} ELSE 1000000 + substr(user_key, 2)::BIGINT // 10 END AS file_id FROM kv), fl AS (SELECT file_id, min(user_key) AS smallest, max(user_key) AS biggest FROM fk GROUP BY file_id)"


@query(f"{_TWO} SELECT a.file_id AS a, b.file_id AS b FROM fl a JOIN fl b ON a.smallest <= b.biggest AND b.smallest <= a.biggest AND a.file_id < b.file_id")
def range_overlap(spark, sf):
    f = _two_layouts(spark, sf)
    return ranges.overlapping(f, f).where("a.file_id < b.file_id").select(F.col("a.file_id").alias("a"), F.col("b.file_id").alias("b"))


@query(f"{_TWO} SELECT * FROM fl WHERE biggest >= 'u000040' AND smallest <= 'u000060'")
def overlapping_files(spark, sf):
    return told(ranges.overlapping_files(_two_layouts(spark, sf), b"u000040", b"u000060").select("file_id", "smallest", "biggest"))


@query(f"{_FILES} SELECT count(*) > 0 AS overlap FROM fl WHERE file_id > 2 AND biggest >= (SELECT min(smallest) FROM fl WHERE file_id <= 2) AND smallest <= (SELECT max(biggest) FROM fl WHERE file_id <= 2)")
def check_overlap(spark, sf):
    f = _files(spark, sf)[1]
    return ranges.any_overlap(f.where("file_id > 2"), f.where("file_id <= 2"))


@query(f"""fk AS (SELECT user_key, version // {FILE_ROWS} AS file_id, row_number() OVER (PARTITION BY version // {FILE_ROWS} ORDER BY user_key, version DESC) AS rn, count(*) OVER (PARTITION BY version // {FILE_ROWS}) AS n FROM kv),
b AS (SELECT *, greatest(floor(ceil(n / {BLOCK_ROWS}.0) / {SPLITS}), 1)::BIGINT AS jump FROM fk WHERE (rn - 1) % {BLOCK_ROWS} = 0)
SELECT file_id, user_key FROM b WHERE ((rn - 1) // {BLOCK_ROWS}) % jump = 0 AND starts_with(user_key, 'u000')""")
def key_splits(spark, sf):
    return told(scan.key_splits(_files(spark, sf)[0], BLOCK_ROWS, SPLITS, b"u000"))


@query("sz AS (SELECT (sum(strlen(user_key) + strlen(value)) * 100)::BIGINT AS s FROM kv), lv AS (SELECT unnest(range(1, 7)) AS level) SELECT level::INT AS level, greatest(s // (10 ** (6 - level))::BIGINT, 10485760)::BIGINT AS target_size FROM sz, lv")
def level_stats(spark, sf):
    total = D.kv_events(spark, sf).agg(F.sum(F.octet_length("user_key") + F.octet_length("value"))).first()[0] * 100
    t = compaction.level_targets(total, M.Options())
    return spark.createDataFrame([(k, t.target_size[k]) for k in range(1, len(t.target_size))], "level int, target_size long")


@query("SELECT max(version) AS max_version FROM kv")
def max_version(spark, sf):
    return snapshot.max_version(D.kv_events(spark, sf))


_OPS = "c AS (SELECT event_id AS seq, CASE WHEN event_type IN ('error', 'signup') THEN 'DELETE' ELSE 'CREATE' END AS op, user_id AS file_id, (event_id % 7)::INT AS level FROM events)"


@query(f"{_OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq DESC) AS rn FROM c) SELECT file_id, level FROM r WHERE rn = 1 AND op = 'CREATE'")
def manifest_replay(spark, sf):
    e = D.table(spark, sf, "events")
    op = F.when(F.col("event_type").isin("error", "signup"), "DELETE").otherwise("CREATE")
    return replay(e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("file_id"), (F.col("event_id") % 7).cast("int").alias("level")))


@query(f"SELECT user_key, {AS_OF}::BIGINT AS version, CASE WHEN value = '1-URGENT' THEN 1 ELSE 0 END AS meta, value, version // 100 AS batch FROM kv", ORDERS)
def write_batch(spark, sf):
    """Blind writes in bounded batches at one timestamp."""
    o = D.kv_orders(spark, sf)
    urgent = F.col("value") == C.lit_bytes(b"1-URGENT")
    return told(o.select("user_key", F.lit(as_of(o)).cast("long").alias("version"), F.when(urgent, M.DELETE).otherwise(0).alias("meta"), "value", F.floor(F.col("version") / 100).cast("long").alias("batch")))


# ------------------------------------------------------------ transactions


_READS = f"r AS (SELECT event_id AS txn_id, event_id AS read_ts, user_id AS k FROM events UNION ALL SELECT event_id, event_id, (user_id + 1) % 150 FROM events), c AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' AND event_id <= (SELECT (max(event_id) + 1) // 2 FROM events))"


def _reads(spark, sf):
    e = D.table(spark, sf, "events")
    keys = F.explode(F.array(F.col("user_id"), (F.col("user_id") + 1) % 150))
    return e.select(F.col("event_id").alias("txn_id"), F.col("event_id").alias("read_ts"), keys.alias("user_key")), e.select(F.col("user_id").alias("user_key"), F.col("event_id").alias("commit_ts"), "event_type")


@query(f"{_READS} SELECT DISTINCT txn_id FROM r WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = r.k AND c.event_id > r.read_ts)")
def ssi_conflicts(spark, sf):
    """Transactions that read a key of theirs or the next one before a purchase of the first half of the log wrote it."""
    reads, writes = _reads(spark, sf)
    return conflicts.conflicting(reads, writes.where((F.col("event_type") == "purchase") & (F.col("commit_ts") <= as_of(D.kv_events(spark, sf)))))


@query(f"SELECT user_id AS user_key, event_id AS commit_ts FROM events WHERE event_id > (SELECT (max(event_id) + 1) // 3 FROM events)")
def committed_cleanup(spark, sf):
    return conflicts.cleanup(_reads(spark, sf)[1].drop("event_type"), discard(D.kv_events(spark, sf)))


@query("m AS (SELECT event_id AS idx, 1 AS b, CASE WHEN event_type = 'purchase' AND event_id > (SELECT 7 * (max(event_id) + 1) // 10 FROM events) THEN 0 ELSE 1 END AS d FROM events) SELECT coalesce(max(idx), 0)::BIGINT AS done_until FROM m WHERE idx < coalesce((SELECT min(idx) FROM m WHERE b > d), 9223372036854775807)")
def watermark_done_until(spark, sf):
    e = D.table(spark, sf, "events")
    late = 7 * as_of(D.kv_events(spark, sf), 1) // 10
    done = F.when((F.col("event_type") == "purchase") & (F.col("event_id") > late), 0).otherwise(1)
    return conflicts.done_until(e.select(F.col("event_id").alias("idx"), F.lit(1).alias("begun"), done.alias("done")))


# ------------------------------------------------------------ beyond the model


@query(f"SELECT {COLS} FROM kv WHERE version > {DISCARD} AND version <= {AS_OF}")
def change_feed_between(spark, sf):
    return told(change_feed(kv := D.kv_events(spark, sf), discard(kv), as_of(kv)))


@query("SELECT user_key, count(*) AS versions, sum(CASE WHEN (meta & 1) <> 0 THEN 1 ELSE 0 END)::BIGINT AS deletes FROM kv GROUP BY user_key")
def version_counts(spark, sf):
    return told(D.kv_events(spark, sf).groupBy("user_key").agg(F.count(F.lit(1)).alias("versions"), F.count(F.when(F.col("meta").bitwiseAND(1) != 0, 1)).alias("deletes")))


@query(f"""a AS (SELECT user_key, max(version) AS v FROM kv WHERE version <= {DISCARD} GROUP BY 1), b AS (SELECT user_key, max(version) AS v FROM kv WHERE version <= {AS_OF} GROUP BY 1)
SELECT coalesce(a.user_key, b.user_key) AS user_key, a.v AS before_version, b.v AS after_version FROM a FULL JOIN b ON a.user_key = b.user_key WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark, sf):
    kv = D.kv_events(spark, sf).select("user_key", "version")
    a, b = (kv.where(C.visible(ts)).groupBy("user_key").agg(F.max("version").alias(n)) for ts, n in ((discard(kv), "before_version"), (as_of(kv), "after_version")))
    return told(a.join(b, "user_key", "full").where(~F.col("before_version").eqNullSafe(F.col("after_version"))))


@query("SELECT user_key, version, value, lag(value) OVER w AS old_value, lag(version) OVER w AS old_version FROM kv WINDOW w AS (PARTITION BY user_key ORDER BY version)")
def value_history(spark, sf):
    return told(history.history(D.kv_events(spark, sf)).select("user_key", "version", "value", "old_value", "old_version"))


@query(f"f AS (SELECT o_orderkey, printf('u%06d', o_custkey % 150) AS k, o_orderkey * 2 AS t FROM orders), j AS (SELECT o_orderkey, value, version, meta, expires_at FROM f ASOF LEFT JOIN kv ON f.k = kv.user_key AND f.t >= kv.version) SELECT o_orderkey, CASE WHEN NOT {DEAD} THEN value END AS value, CASE WHEN NOT {DEAD} THEN version END AS version FROM j")
def asof_join(spark, sf):
    """Orders with the newest event of a user at the time of the order."""
    f = D.table(spark, sf, "orders").select("o_orderkey", F.encode(F.format_string("u%06d", F.col("o_custkey") % 150), "UTF-8").alias("k"), (F.col("o_orderkey") * 2).alias("t"))
    return told(history.asof_join(f, D.kv_events(spark, sf), "k", "t", NOW).select("o_orderkey", "value", "version"))


@query(f"m AS (SELECT *, version = max(version) OVER (PARTITION BY user_key) AS newest FROM kv) SELECT CASE WHEN NOT newest THEN 'old' WHEN {DEAD} THEN 'dead' ELSE 'live' END AS state, count(*) AS n_rows, sum(strlen(value))::BIGINT AS bytes, sum(CASE WHEN (meta & 1) <> 0 THEN 1 ELSE 0 END)::BIGINT AS deletes FROM m GROUP BY 1")
def garbage_stats(spark, sf):
    return history.garbage(D.kv_events(spark, sf), NOW)


# ------------------------------------------------------------ the store itself


def _empty(spark, **options) -> KVStore:
    return KVStore.open(spark, M.Options(dir=scratch(spark), **{"num_versions_to_keep": M.KEEP_ALL} | options))


def _loaded(spark, sf, **options) -> tuple[KVStore, DataFrame]:
    """A store on disk that holds all events, in three commits by age."""
    kv, s = D.kv_events(spark, sf), _empty(spark, **options)
    third = discard(kv)
    for part in (F.col("version") <= third, (F.col("version") > third) & (F.col("version") <= 2 * third), F.col("version") > 2 * third):
        s.append(kv.where(part))
    return s, kv


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD}")
def store_scan(spark, sf):
    s, kv = _loaded(spark, sf)
    return told(s.scan(as_of(kv), NOW))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD} AND user_key <= 'u000049' ORDER BY user_key DESC LIMIT {LIMIT}")
def store_seek_reverse(spark, sf):
    s, kv = _loaded(spark, sf)
    return told(s.seek(SEEK_BACK, as_of(kv), NOW, reverse=True, limit=LIMIT))


@query(f"{_latest()} SELECT user_key, version, user_meta FROM l WHERE NOT {DEAD}")
def store_keys_only(spark, sf):
    """A scan that reads no values."""
    s, kv = _loaded(spark, sf, value_threshold=8)
    return told(s.scan(as_of(kv), NOW, values=False).select("user_key", "version", "user_meta"))


@query(f"SELECT {COLS} FROM kv WHERE user_key = 'u000042' AND version <= {AS_OF}")
def store_one_key(spark, sf):
    """All versions of one key: the prefix is the key."""
    s, kv = _loaded(spark, sf)
    return told(s.all_versions(as_of(kv), prefix=GET, prefix_is_key=True))


@query(f"{_latest()} SELECT * FROM l WHERE NOT {DEAD} AND user_key IN (SELECT printf('u%06d', user_id) FROM events WHERE event_type = 'purchase')")
def store_get_many(spark, sf):
    s, kv = _loaded(spark, sf)
    keys = D.table(spark, sf, "events").where("event_type = 'purchase'").select(F.encode(F.format_string("u%06d", "user_id"), "UTF-8").alias("user_key"))
    return told(s.get_many(keys, as_of(kv), NOW))


@query("SELECT user_key, strlen(value)::INT AS value_len, md5(value) AS value_md5 FROM kv", DOCS)
def store_blobs(spark, sf):
    """Documents through a store that keeps large values apart."""
    s = _empty(spark, value_threshold=THRESHOLD)
    s.append(D.kv_docs(spark, sf))
    return told(s.scan(now_ms=NOW).select("user_key", F.octet_length("value").alias("value_len"), F.md5("value").alias("value_md5")))


@query("SELECT count(*) AS n_rows, min(user_key) AS smallest, max(user_key) AS biggest, min(version) AS min_version, max(version) AS max_version FROM kv")
def store_stats(spark, sf):
    """The file list of a store, summed up: every row is in a file once."""
    s, _ = _loaded(spark, sf)
    return told(s.stats().agg(F.sum("n_rows").alias("n_rows"), F.min("smallest").alias("smallest"), F.max("biggest").alias("biggest"), F.min("min_version").alias("min_version"), F.max("max_version").alias("max_version")))


@query(_retain_sql(DISCARD, 1, False))
def store_compact(spark, sf):
    s, kv = _loaded(spark, sf)
    s.compact(discard(kv), 1, NOW)
    return told(s.all_versions())


_RANGE_KEYS = "starts_with(user_key, 'u00002')"


@query(_retain_sql(f"CASE WHEN {_RANGE_KEYS} THEN {AS_OF} ELSE {DISCARD} END", 1, False))
def store_compact_range(spark, sf):
    """Old entries are compacted into base files up to a third of the log. Newer ones of some keys
    follow as a delta, and a step rewrites only the base files that it touches, up to half of the
    log; the rest stay deltas."""
    kv, s = D.kv_events(spark, sf), _empty(spark, base_level_size=5_000)
    third, half = discard(kv), as_of(kv)
    s.append(kv.where(F.col("version") <= third))
    s.compact(third, 1, NOW)
    some = C.has_prefix("user_key", b"u00002")
    s.append(kv.where((F.col("version") > third) & some))
    s.compact_step(half, 1, NOW)
    s.append(kv.where((F.col("version") > third) & ~some))
    return told(s.all_versions())


_MINE = f"l AS (SELECT {COLS}, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS rn FROM kv WHERE user_key NOT IN ('u000003', 'u000005'))"


@query(f"{_MINE} SELECT {COLS} FROM l WHERE rn = 1 AND NOT {DEAD} UNION ALL SELECT 'u000003', (SELECT max(version) FROM kv), 0, 7, 0::BIGINT, 'mine'")
def txn_read_your_writes(spark, sf):
    """A transaction's scan shows its own write and delete over the snapshot."""
    s, _ = _loaded(spark, sf)
    t = s.begin(True)
    t.set_entry(Entry(b"u000003", b"mine", user_meta=7))
    t.delete(b"u000005")
    return told(t.scan(now_ms=NOW))


@query(f"{_MINE} SELECT {COLS} FROM l WHERE rn = 1 AND NOT {DEAD} UNION ALL SELECT 'u000003', (SELECT max(version) FROM kv) + 1, 0, 7, 0::BIGINT, 'mine'")
def txn_commit(spark, sf):
    """The same after the commit, at the next timestamp."""
    s, _ = _loaded(spark, sf)
    with s.update() as t:
        t.set_entry(Entry(b"u000003", b"mine", user_meta=7))
        t.delete(b"u000005")
    return told(s.scan(now_ms=NOW))


@query("SELECT * FROM (VALUES (1, 'committed'), (2, 'conflict'), (3, 'committed'), (4, 'committed'), (5, 'nothing to write'), (6, 'discarded')) AS t(txn, outcome)")
def txn_conflicts(spark, sf):
    """1 and 2 read one key and write it; 3 writes it blindly; 4 reads another; 5 only reads; 6 is given up."""
    s = _empty(spark)
    with s.update() as t:
        t.set(b"x", b"0")
        t.set(b"y", b"0")
    txns = {k: s.begin(True) for k in range(1, 7)}
    for k, key in ((1, b"x"), (2, b"x"), (4, b"y"), (5, b"x")):
        txns[k].get(key)
    for k, key in ((1, b"x"), (2, b"x"), (3, b"x"), (4, b"z"), (6, b"y")):
        txns[k].set(key, b"%d" % k)
    txns[6].discard()
    out = []
    for k, t in txns.items():
        try:
            out.append((k, "committed" if t.commit() else "nothing to write"))
        except M.Conflict:
            out.append((k, "conflict"))
        except M.DiscardedTxn:
            out.append((k, "discarded"))
    return spark.createDataFrame(out, "txn int, outcome string")


@query("SELECT * FROM (VALUES (2, 'a', 2, 'one'), (4, 'a', 4, 'two'), (4, 'b', 3, 'three'), (9, 'a', 4, 'two'), (9, 'b', 9, 'four')) AS t(read_ts, user_key, version, value)")
def txn_managed(spark, sf):
    """Timestamps given by the caller; what is under the discard timestamp goes in a compaction."""
    s = _empty(spark, managed_txns=True, num_versions_to_keep=1)
    for ts, key, value in ((2, b"a", b"one"), (4, b"a", b"two"), (3, b"b", b"three"), (9, b"b", b"four")):
        t = s.begin_at(ts - 1, True)
        t.set(key, value)
        t.commit_at(ts)
    out = []
    for ts in (2, 4, 9):
        if ts == 9:
            s.set_discard_ts(9)
            s.compact(now_ms=NOW)
        out += [(ts, i.key.decode(), i.version, i.value.decode()) for i in s.begin_at(ts).items(now_ms=NOW)]
    return spark.createDataFrame(out, "read_ts int, user_key string, version int, value string")


@query("SELECT printf('s%05d', s_suppkey) AS user_key, s_name AS value FROM supplier WHERE s_nationkey <> 0", "kv AS (SELECT 1)")
def store_write_batch(spark, sf):
    """All suppliers written in batches of at most ten, those of one nation deleted in others."""
    s = _empty(spark, max_batch_count=11, num_level_zero_tables_stall=50)
    suppliers = D.table(spark, sf, "supplier").orderBy("s_suppkey")
    b = s.write_batch()
    for r in suppliers.select("s_suppkey", "s_name").toLocalIterator():
        b.set(b"s%05d" % r.s_suppkey, r.s_name.encode())
    b.flush()
    b = s.write_batch()
    for r in suppliers.where("s_nationkey = 0").select("s_suppkey").toLocalIterator():
        b.delete(b"s%05d" % r.s_suppkey)
    b.flush()
    return told(s.scan(now_ms=NOW).select("user_key", "value"))


@query("r AS (SELECT n_regionkey AS k, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY 1) SELECT a.k AS a, b.k AS b, a.lo <= b.hi AND b.lo <= a.hi AS overlaps, least(a.lo, b.lo) AS smallest, greatest(a.hi, b.hi) AS biggest FROM r a, r b", "kv AS (SELECT 1)")
def key_range_algebra(spark, sf):
    """Overlap and hull of the ranges of nation names of every two regions."""
    got = D.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("lo"), F.max("n_name").alias("hi")).collect()
    of = {r.n_regionkey: ranges.KeyRange(r.lo.encode(), r.hi.encode()) for r in got}
    rows = [(a, b, x.overlaps(y), x.extend(y).left.decode(), x.extend(y).right.decode()) for a, x in of.items() for b, y in of.items()]
    return spark.createDataFrame(rows, D.table(spark, sf, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_regionkey").alias("b")).schema.add("overlaps", "boolean").add("smallest", "string").add("biggest", "string"))
