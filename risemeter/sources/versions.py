"""Versions of tables that change together.

Every version has data folders of its own, which never change once written. A small JSON table of manifests, in one folder per
version, names them. A version counts from the moment its manifest is renamed into place: readers see all of its tables or none, and
what they have opened stays as it is. The rename never replaces a version, so of two writers that start from one version only one
gets through. This holds on file systems that rename folders atomically (HDFS and the like).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

MANIFEST = "name string, path string, rows long"


class VersionMoved(ValueError):
    """Another writer has published since the version that a change was made from."""


@dataclass(frozen=True)
class Version:
    """Tables of a published version and their row counts; number 0 stands for no version yet."""

    number: int
    tables: dict[str, DataFrame]
    rows: dict[str, int]


def current_version(spark: SparkSession, root: str) -> Version:
    """The newest published version below ``root``."""
    folder = f"{root}/manifests"
    if not _exists(spark, folder):
        return Version(0, {}, {})
    listed = spark.read.schema(f"{MANIFEST}, version long").json(folder)
    number = listed.agg(F.max("version")).first()[0] or 0
    named = listed.where(F.col("version") == number).collect()  # one row per table
    return Version(number, {r.name: spark.read.parquet(f"{root}/{r.path}") for r in named}, {r.name: r.rows for r in named})


def publish_version(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    root: str,
    base: int,
    check: Callable[[dict[str, DataFrame]], DataFrame] | None = None,
) -> Version:
    """Write ``tables`` as the version after ``base``, verify what was written, and switch to it as the last step.

    ``check`` gets the stored tables and returns problem rows. With any problem, or if the version moved on from ``base`` meanwhile,
    nothing is published and readers stay where they are. Rows are counted by the write itself.
    """
    _expect(current_version(spark, root).number, base)
    folder, counts, stored = f"data/{base + 1}-{uuid.uuid4().hex}", {}, {}
    for name, rows in tables.items():
        seen, path = Observation(), f"{root}/{folder}/{name}"
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(path)
        counts[name] = seen.get.get("rows", 0)
        stored[name] = spark.read.schema(rows.schema).parquet(path)
    if check is not None and not check(stored).isEmpty():
        raise ValueError(f"the tables written to {root}/{folder} fail their check")
    # Spark's readers pass over names that begin with an underscore.
    staged = f"{root}/manifests/_staged-{uuid.uuid4().hex}"
    named = [(name, f"{folder}/{name}", counts[name]) for name in tables]
    spark.createDataFrame(named, MANIFEST).coalesce(1).write.json(staged)
    if not _moved_to(spark, staged, f"{root}/manifests/version={base + 1}"):
        _expect(current_version(spark, root).number, base)
    return Version(base + 1, stored, counts)


def _expect(number: int, base: int) -> None:
    if number != base:
        raise VersionMoved(f"version {number} is published; the change was made from version {base}")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _moved_to(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if there is a ``target`` already."""
    context = spark.sparkContext
    hadoop, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    old, new = hadoop.Path(source), hadoop.Path(target)
    files = hadoop.FileContext.getFileContext(old.getFileSystem(conf).getUri(), conf)
    no_replacement = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        files.rename(files.makeQualified(old), files.makeQualified(new), no_replacement)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
