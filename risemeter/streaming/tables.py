"""Batch-wise tables behind ``foreachBatch``.

Each micro-batch overwrites its own ``batch_id=`` folder, so a repeated batch leaves the same
rows, and earlier batches are read without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def prepare(spark: SparkSession, folder: str, schema, by: str | None = None) -> None:
    """Make the table readable before the first batch."""
    writer = spark.createDataFrame([], schema).write.mode("ignore")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/batch_id=-1")


def stored(spark: SparkSession, folder: str, schema, before: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def store(rows: DataFrame, folder: str, batch_id: int, by: str | None = None) -> None:
    """Write the rows of a batch, with a folder per value of ``by`` inside the batch's own."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/batch_id={batch_id}")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: outside the heap, and changed keys only are written."""
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived and stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
