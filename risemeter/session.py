"""Session settings the jobs are written for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Snapshot days and week starts are defined on UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # AQE sizes partitions, turns small joins into broadcasts from measured sizes
    # and splits skewed join partitions, also below an aggregation.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "risemeter", master: str | None = None, **extra: str) -> SparkSession:
    """Create a session; pass further settings as ``name="value"`` pairs in ``extra``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/risemeter/{name}-{uuid.uuid4().hex}"


def spread(rows, *keys: str):
    """``rows`` by ``keys`` in all shuffle partitions, for stages that hold several sorts or maps of their rows at a time.

    Spark merges other shuffle partitions by their compressed bytes, up to 64 MB, which narrow rows unpack to many times that.
    A count that is asked for stays, and with it the tasks of every join and grouping in the same stage.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def checkpointed(df, spark: SparkSession):
    """Cut the lineage of ``df`` through the shared checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df, name: str):
    """Cut the lineage of ``df`` by a written table in the shared folder, whose size Spark knows when it picks joins."""
    spark, folder = df.sparkSession, fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
