"""Orders, top lists and pages.

Every order ends in a unique key so that results are stable. ``orderBy(..).limit(n)`` becomes
TakeOrderedAndProject: each task keeps n rows and only those travel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from risemeter.session import checkpointed

# Locales of the orders and list sizes.
NAME_COLLATION = "ja"
ID_COLLATION = "UNICODE"
DIGEST_SIZE = 5
VISIBLE_STEP = 20
ENTITY_ITEMS = 100


def by_name(column: str = "name") -> Column:
    return F.collate(F.col(column), NAME_COLLATION).asc()


def by_id(column: str) -> Column:
    return F.collate(F.col(column).cast("string"), ID_COLLATION).asc()


def rising(compared: DataFrame, key: str = "entity_id") -> DataFrame:
    return compared.where(F.col("delta") > 0).orderBy(F.desc("delta"), by_name(), key)


def falling(compared: DataFrame, key: str = "entity_id") -> DataFrame:
    return compared.where(F.col("delta") < 0).orderBy(F.asc("delta"), by_name(), key)


def by_growth_rate(compared: DataFrame, upwards: bool, key: str = "entity_id") -> DataFrame:
    side = F.desc if upwards else F.asc
    return compared.orderBy(side("delta_pct"), side("delta"), by_name(), key)


def trending_order() -> list[Column]:
    return [F.desc("delta"), F.desc("view_count"), by_id("item_id")]


def momentum_order() -> list[Column]:
    return [F.desc("recent_views"), F.desc("total_views"), F.asc("catalog_id")]


def item_order(mode: str) -> list[Column]:
    """newest, views or rising; unknown publish dates come last."""
    if mode == "rising":
        return trending_order()
    newest, views = F.desc_nulls_last("published_at"), F.desc("view_count")
    first = [views, newest] if mode == "views" else [newest, views]
    return [*first, by_id("item_id")]


def candidate_order() -> list[Column]:
    return [F.desc("score"), F.desc("item_count"), F.collate(F.col("title"), ID_COLLATION).asc(), F.asc("external_id")]


def by_audience() -> list[Column]:
    return [F.desc(F.coalesce("latest_value", F.lit(0))), F.asc("entity_id")]


def top(rows: DataFrame, order: list[Column], n: int = DIGEST_SIZE) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def clamp_limit(parameter: str | int | None, default: int, maximum: int) -> int:
    """A whole number of at least 1, at most ``maximum``; the default for anything else."""
    try:
        number = float(default if parameter is None else parameter)
    except ValueError:
        return default
    return default if not math.isfinite(number) or number < 1 or number != int(number) else min(int(number), maximum)


def offset_from(parameter: str | int | None) -> int:
    try:
        number = float(0 if parameter is None else parameter)
    except ValueError:
        return 0
    return int(number) if math.isfinite(number) and number > 0 and number == int(number) else 0


def page_after(ranked: DataFrame, limit: int, after: tuple[int, int, str] | None = None) -> DataFrame:
    """The page behind the key (delta, view_count, item_id), with ``has_next`` on every row.

    One row beyond the page is read to know whether a next page exists; the closing count runs
    over those limit + 1 rows only.
    """
    rows = ranked
    if after is not None:
        delta, views, item_id = after
        item = F.collate(F.col("item_id").cast("string"), ID_COLLATION)
        last = F.collate(F.lit(str(item_id)), ID_COLLATION)
        rows = rows.where(
            (F.col("delta") < delta)
            | ((F.col("delta") == delta) & (F.col("view_count") < views))
            | ((F.col("delta") == delta) & (F.col("view_count") == views) & (item > last))
        )
    page = rows.orderBy(*trending_order()).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))
    numbered = page.select(
        "*",
        F.row_number().over(everything.orderBy(*trending_order())).alias("_position"),
        F.count(F.lit(1)).over(everything).alias("_rows"),
    )
    return (
        numbered.where(F.col("_position") <= limit)
        .withColumn("has_next", F.col("_rows") > limit)
        .drop("_position", "_rows")
    )


def visible_slice(ranked: DataFrame, order: list[Column], shown: int, n: int = VISIBLE_STEP) -> DataFrame:
    """The list after one more press of the grow button."""
    return ranked.orderBy(*order).limit(shown + n)


def with_positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number all rows of a total order without bringing them into one task.

    The sorted rows are checkpointed once, which fixes their range partitions. Each partition is
    then numbered on its own, offset by the rows of the partitions before it; only one count per
    partition is ever brought together.
    """
    ordered = checkpointed(rows.orderBy(*order), rows.sparkSession)
    marked = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(before, "_part").withColumn(name, F.col("_before") + inside + 1).drop("_at", "_part", "_before")
