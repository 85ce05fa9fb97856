"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import importlib.util
import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidelog.model import Options  # noqa: E402
from tidelog.operators import scan, snapshot  # noqa: E402
from tidelog.queries import QUERIES  # noqa: E402
from tidelog.sources import datasets  # noqa: E402
from tidelog.store import KVStore  # noqa: E402

NOW = 1_705_320_000_000
HEADLINE = ["point_get", "multi_get", "scan_asof", "scan_reverse", "scan_all_versions", "seek_forward", "prefix_scan", "read_your_writes", "merge_sources", "merge_dedupe", "compact_keep1", "compact_keepN", "compact_overlap", "latest_n_versions", "value_resolve", "encode_internal_key", "ssi_conflicts", "file_key_ranges", "manifest_replay", "nearest_ge"]


def timed(f, repeat: int = 3) -> float:
    best = float("inf")
    for _ in range(repeat):
        t = time.perf_counter()
        f()
        best = min(best, time.perf_counter() - t)
    return round(best, 4)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def store_cases(spark, sf: str, root: str) -> dict[str, float]:
    """Bulk load, 16 seeks of 10,001 rows, batched point reads and compaction of a store on disk."""
    kv = datasets.kv_lineitem(spark, sf).select("user_key", "version", "meta", "user_meta", "expires_at", "value").dropDuplicates(["user_key", "version"])
    kv = kv.cache()
    kv.count()
    out, n = {}, iter(range(100))

    def load():
        KVStore.open(spark, Options(dir=f"{root}/{next(n)}")).append(kv)

    out["store_bulk_load"] = timed(load, 2)
    store = KVStore.open(spark, Options(dir=f"{root}/0"))
    store.append(kv.where("version = 1").withColumn("version", F.lit(9).cast("long")))
    out["store_scan_asof"] = timed(lambda: sink(store.scan(9, NOW)))
    out["store_seek_10001"] = timed(lambda: sink(store.seek(b"o0000050000", 9, NOW, limit=10_001)))
    keys = kv.select("user_key").distinct().limit(100_000).cache()
    keys.count()
    out["store_get_many_100k"] = timed(lambda: sink(store.get_many(keys, 9, NOW)))
    out["store_compact"] = timed(lambda: store.compact(9, 1, NOW), 1)
    out["store_scan_compacted"] = timed(lambda: sink(store.scan(9, NOW)))
    kv.unpersist()
    return out


def merge_cases(spark) -> dict[str, float]:
    """Two runs of 2,500,000 equal keys, merged and put together."""
    rows = spark.range(2_500_000).selectExpr("encode(lpad(hex(id), 16, '0'), 'UTF-8') AS user_key", "cast(0 AS long) AS version", "0 AS meta", "0 AS user_meta", "cast(0 AS long) AS expires_at", "encode(cast(id AS string), 'UTF-8') AS value").cache()
    rows.count()
    out = {"merge_2x2500k": timed(lambda: sink(snapshot.merge([rows, rows])), 2), "concat_2x2500k": timed(lambda: sink(snapshot.concat([rows, rows])), 2)}
    out["scan_2500k_ordered"] = timed(lambda: sink(scan.ordered(rows)), 2)
    rows.unpersist()
    return out


def corpus_cases(spark, sf: str) -> dict[str, float]:
    """Every training-data query and the pipeline, once each, where the subpackage is there."""
    if importlib.util.find_spec("tidelog.llm") is None or importlib.util.find_spec("corpus_pipeline") is None:
        return {}
    import corpus_pipeline
    from tidelog.llm.queries import QUERIES as corpus

    every = {**corpus, "pipeline": corpus_pipeline.run}
    return {name: timed(lambda f=f: sink(f(spark, sf)), 1) for name, f in every.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda f=QUERIES[name]: sink(f(spark, sf))) for name in HEADLINE}
    root = tempfile.mkdtemp(prefix="bench-")
    try:
        times |= store_cases(spark, sf, root) | merge_cases(spark) | corpus_cases(spark, sf)
    finally:
        shutil.rmtree(root, ignore_errors=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
