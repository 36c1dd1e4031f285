"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from risemeter.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views under ``name``."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


def text(*columns: str) -> list[Column]:
    """Columns as text, for dates and times."""
    return [F.col(c).cast("string").alias(c) for c in columns]


def whole(*columns: str) -> list[Column]:
    """Columns as 64-bit whole numbers."""
    return [F.col(c).cast("long").alias(c) for c in columns]
