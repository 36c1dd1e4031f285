"""Set operations on arrays, id sets and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def union_strings(*arrays: Column) -> Column:
    """Distinct strings of all arrays in order; NULL arrays act as empty."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))


def added_strings(after: Column, before: Column) -> Column:
    """Elements of ``after`` that ``before`` lacks."""
    return F.array_except(after, F.coalesce(before, F.array().cast("array<string>")))


def shared_items(links: DataFrame, catalog_ids: list[int]) -> DataFrame:
    """Items linked to every one of the given catalog ids."""
    chosen = links.where(F.col("catalog_id").isin(catalog_ids)).select("item_id", "catalog_id").distinct()
    counted = chosen.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") == len(set(catalog_ids))).select("item_id")


def last_per_name(*catalogs: DataFrame) -> DataFrame:
    """Union of seed lists; for equal names the entry of the later list, then position, wins."""
    rows = None
    for order, catalog in enumerate(catalogs):
        part = catalog.withColumn("_source", F.lit(order))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    others = [c for c in rows.columns if c != "name"]
    chosen = rows.groupBy("name").agg(F.max_by(F.struct(*others), F.struct("_source", "position")).alias("_row"))
    return chosen.select("name", *[F.col(f"_row.{c}").alias(c) for c in others if c != "_source"])


def rekey(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Point rows of duplicate catalog ids at their canonical id.

    ``groups`` is (canonical_id, duplicate_id) with unique duplicates. ``was_duplicate`` marks
    the moved rows.
    """
    moves = groups.select(F.col("duplicate_id").alias("catalog_id"), "canonical_id")
    joined = rows.join(moves, "catalog_id", "left")
    return joined.select(
        *[F.coalesce("canonical_id", "catalog_id").alias("catalog_id") if c == "catalog_id" else F.col(c) for c in rows.columns],
        F.col("canonical_id").isNotNull().alias("was_duplicate"),
    )


def merged_and_removed(rows: DataFrame, groups: DataFrame, key: str, row_id: str) -> DataFrame:
    """Re-keyed rows with ``removed`` set on all but the first row per (catalog, key)."""
    moved = rekey(rows, groups).drop("was_duplicate")
    first = moved.groupBy("catalog_id", key).agg(F.min(row_id).alias("_first"))
    return moved.join(first, ["catalog_id", key]).withColumn("removed", F.col(row_id) != F.col("_first")).drop("_first")


def differing_ids(actual: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """Ids on one side only, duplicates counted: an equality gate passes when this is empty."""
    a, b = actual.select(column), expected.select(column)
    return (
        a.exceptAll(b).withColumn("side", F.lit("unexpected"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))
    )
