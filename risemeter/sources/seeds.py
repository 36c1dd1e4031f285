"""Seed lists and reviewed alias files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENTITY_SEED = "handle STRING, external_id STRING, name STRING, category STRING, active BOOLEAN"
CATALOG_SEED = (
    "name STRING, maker STRING, type STRING, release_date DATE, short_name STRING, series STRING, "
    "aliases ARRAY<STRING>, unique_aliases ARRAY<STRING>, ambiguous_aliases ARRAY<STRING>, "
    "resolving_keywords ARRAY<STRING>, exclude_terms ARRAY<STRING>, source_url STRING, official_url STRING"
)
ALIAS_FILE = (
    "suggestions ARRAY<STRUCT<machineId: BIGINT, shortName: STRING, aliases: ARRAY<STRING>, "
    "excludeTerms: ARRAY<STRING>, approved: BOOLEAN>>"
)


def read_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines seed list. ``position`` follows file order."""
    return spark.read.schema(schema).json(path).withColumn("position", F.monotonically_increasing_id())


def read_alias_file(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Suggestions of reviewed alias files with their approval: one body per file, or per line without ``multi_line``.

    Of several files the one that is later by path overrules; bodies of one file must not name an entry twice.
    """
    files = spark.read.schema(ALIAS_FILE).option("multiLine", multi_line).json(path)
    return alias_suggestions(files.select("suggestions", F.col("_metadata.file_path").alias("file")), "file")


def alias_suggestions(files: DataFrame, *order: str) -> DataFrame:
    """One row per suggestion; ``position`` follows ``order`` and the place in the body, as later suggestions overrule earlier ones."""
    listed = files.select(*order, F.posexplode("suggestions").alias("place", "s"))
    return listed.select(
        (F.struct(*order, "place") if order else F.col("place")).alias("position"),
        F.col("s.machineId").alias("catalog_id"),
        F.col("s.shortName").alias("short_name"),
        F.col("s.aliases").alias("aliases"),
        F.col("s.excludeTerms").alias("exclude_terms"),
        F.coalesce("s.approved", F.lit(False)).alias("approved"),
    )


def approved_aliases(suggestions: DataFrame) -> DataFrame:
    return suggestions.where(F.col("approved")).drop("approved")
