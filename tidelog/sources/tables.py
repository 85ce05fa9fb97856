"""Parquet files of a store: sorted by key ascending and version descending,
with statistics, key filters and page checksums; large values in files of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec as C
from ..model import KV_SCHEMA, MAX_KEY_LENGTH, KVError, Options
from ..operators.snapshot import separate_values
from .files import Files
from .manifest import FileEntry

REF = T.StructType([T.StructField("file_id", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("offset", T.LongType())])
FILE_SCHEMA = T.StructType([*(T.StructField(f.name, f.dataType) for f in KV_SCHEMA), T.StructField("value_ref", REF), T.StructField("seq", T.LongType())])
BLOB_SCHEMA = T.StructType([T.StructField("file_id", T.IntegerType()), T.StructField("user_key", T.BinaryType()), T.StructField("version", T.LongType()), T.StructField("payload", T.BinaryType())])


def _writer(df: DataFrame, o: Options):
    w = df.write.option("parquet.page.size", str(o.block_size * 16)).option("parquet.writer.version", "v2").option("parquet.page.write-checksum.enabled", "true")
    for k, v in C.bloom_options(o.bloom_false_positive).items():
        w = w.option(k, v)
    return w


def _invalid() -> Column:
    """The number of rows whose key or version a store does not take."""
    key = F.col("user_key")
    ok = key.isNotNull() & (F.octet_length(key) > 0) & (F.octet_length(key) <= MAX_KEY_LENGTH) & ~C.internal() & (F.col("version") >= 1)
    return F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))


def _refuse(bad: int, twice: int) -> None:
    if bad:
        raise KVError(f"{bad} rows have an invalid key or version")
    if twice:
        raise KVError("a key and version occurs twice")


def check(df: DataFrame, unique: bool) -> int:
    """The greatest version of rows that are kept in memory, after the checks that :func:`write` makes."""
    found = df.agg(_invalid().alias("bad"), F.max("version").alias("v")).first()
    _refuse(found["bad"], df.groupBy("user_key", "version").count().where("count > 1").limit(1).count() if unique else 0)
    return found["v"] or 0


def write(df: DataFrame, files: Files, vfiles: Files, o: Options, level: int, seq: int, parts: int | None = None, unique: bool = False, dealt: bool = False) -> tuple[list[FileEntry], int]:
    """Write rows of KV_SCHEMA (and seq and value_ref where they have them) as sorted files: one entry a file, and
    the greatest version.

    All versions of a key land in one file, since ranges cut between keys, so the
    same pass over the sorted rows counts those that occur twice (``unique``) and
    those that are invalid, and sees whether any value is stored apart. Rows that
    are ``dealt`` and sorted already stay where they are."""
    spark = df.sparkSession
    name = f"data/{uuid.uuid4().hex}"
    apart = "value_ref" not in df.columns and o.value_threshold > 0
    rows = df
    if apart:
        df, _ = separate_values(df, o.value_threshold, seq)
    elif "value_ref" not in df.columns:
        df = df.withColumn("value_ref", F.lit(None).cast(REF))
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.lit(seq).cast("long"))
    df = df.select(*FILE_SCHEMA.fieldNames())
    if not dealt:
        df = (df.repartitionByRange(parts, "user_key") if parts else df.repartitionByRange("user_key")).sortWithinPartitions("user_key", F.desc("version"))
    twice = F.count(F.lit(None))
    if unique:
        w = Window.partitionBy("user_key").orderBy(F.desc("version"))
        df = df.withColumn("_twice", F.col("version").eqNullSafe(F.lag("version").over(w)) & F.col("user_key").isNotNull())
        twice = F.count(F.when(F.col("_twice"), 1))
    seen = Observation()
    df = df.observe(seen, F.max("version").alias("v"), F.count("value_ref").alias("apart"), _invalid().alias("bad"), twice.alias("twice"))
    _writer(df.drop("_twice"), o).parquet(files.at(name))
    found = seen.get
    try:
        _refuse(found["bad"] or 0, found["twice"] or 0)
    except KVError:
        files.delete(name)
        raise
    blob = ""
    if apart and found["apart"]:
        blob = f"blobs/{seq:012d}-{uuid.uuid4().hex}"
        _, large = separate_values(rows, o.value_threshold, seq)
        large.write.option("maxRecordsPerFile", str(o.value_log_max_entries)).parquet(vfiles.at(blob))
    if found["v"] is None:
        files.delete(name)
        return [], 0
    # keys and versions only: statistics of a few columns of what was just written
    back = spark.read.schema(FILE_SCHEMA).parquet(files.at(name))
    path = F.col("_metadata.file_path")
    stats = back.groupBy(path.alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.hex(F.min("user_key")).alias("lo"), F.hex(F.max("user_key")).alias("hi"), F.min("version").alias("v0"), F.max("version").alias("v1"), F.count(F.lit(1)).alias("n"))
    return [FileEntry(uuid.uuid4().hex, r["path"], level, seq, r["lo"].lower(), r["hi"].lower(), r["v0"], r["v1"], r["n"], r["size"], blob) for r in stats.orderBy("lo").collect()], found["v"]


def read(spark, entries: list[FileEntry], verify: bool = False) -> DataFrame:
    """Rows of the files, with ``seq``, by which a newer source goes first. ``verify`` checks every page against its checksum."""
    if not entries:
        return spark.createDataFrame([], FILE_SCHEMA)
    return spark.read.schema(FILE_SCHEMA).option("parquet.page.verify-checksum.enabled", str(verify).lower()).parquet(*(f.path for f in entries))


def read_blobs(spark, files: Files, names: set[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], BLOB_SCHEMA)
    return spark.read.schema(BLOB_SCHEMA).parquet(*(files.at(n) for n in sorted(names)))
