"""Snapshot ingest as a stream: the first row per (key, day) stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructType

from risemeter.sources.sinks import new_snapshots
from risemeter.streaming.tables import prepare, run_available, store, stored


def first_within_watermark(stream: DataFrame, key: str, collected_at: str, delay: str) -> DataFrame:
    """First arrival per (key, date) as long as repeats come within ``delay``; state is bounded by it."""
    return stream.withWatermark(collected_at, delay).dropDuplicatesWithinWatermark([key, "date"])


def ingest_first_snapshots(stream: DataFrame, folder: str, key: str, order: Column) -> DataFrame:
    """Exact rule for any lateness: a batch adds only (key, date) pairs that are not stored yet.

    Stored rows lie in folders by day; a batch reads those of its own range of days only, and of them the keys. Returns the stored table.
    """
    spark, schema, table = stream.sparkSession, stream.schema, f"{folder}/snapshots"
    prepare(spark, table, schema, by="date")
    readable = StructType(list(schema.fields)).add("batch_id", IntegerType())

    def handle(batch: DataFrame, batch_id: int) -> None:
        days = batch.agg(F.min("date"), F.max("date")).first()
        if days[0] is None:
            return
        known = stored(batch.sparkSession, table, readable, before=batch_id).where(F.col("date").between(*days))
        store(new_snapshots(known, batch, key, order).select(*schema.names), table, batch_id, by="date")

    run_available(stream, handle, f"{folder}/checkpoint")
    return stored(spark, table, readable).drop("batch_id")
