"""Scans of stored tables. Filters and column lists given here reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def active_entities(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("active"))


def lookup(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows whose key equals a literal."""
    return rows.where(F.col(column) == F.lit(value))
