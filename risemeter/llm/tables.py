"""Tables of the test data, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="risemeter-llm-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset (tests in local mode), one of this process."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder()).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``saved``, in as many buckets of ``key`` as the session has shuffle partitions: joins on ``key`` leave these rows in place."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.option("path", f"{shared_folder(spark)}/llm/{table}").bucketBy(buckets, key)
    writer.saveAsTable(table, format="parquet")
    return spark.table(table)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
