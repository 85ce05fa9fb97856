"""Streaming ingestion: each micro-batch is one commit of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KV_SCHEMA
from ..operators.snapshot import first_wins
from ..store import KVStore


def ingest(stream: DataFrame, store: KVStore, checkpoint: str, available_now: bool = True):
    """Start appending a stream of entries. A batch that is run again after a failure
    writes the same keys and versions, which count once: the newest source wins."""

    def append(batch: DataFrame, _: int) -> None:
        batch = first_wins(batch.select(*KV_SCHEMA.fieldNames()), "meta", F.desc("value"))
        if batch.limit(1).count():
            store.append(batch, known_unique=True)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def change_feed(df: DataFrame, after: int, upto: int) -> DataFrame:
    """Entries with a version in (after, upto]."""
    return df.where((F.col("version") > after) & (F.col("version") <= upto))
