"""Growth rankings and views of single entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.operators.ranking import ENTITY_ITEMS, falling, item_order, rising
from risemeter.operators.snapshots import chart_series, daily_rows, newest_vs_oldest_of_last, period_comparison
from risemeter.sources.tables import active_entities, lookup

_SHOWN = ["entity_id", "name", "external_id", "handle", "category", "thumbnail_url"]


def growth_ranking(entities: DataFrame, daily: DataFrame, period: int) -> DataFrame:
    """Active entities on the rising, falling or insufficient list; no change is on none.

    Snapshots are reduced to one row per entity before they meet the entity table. Rows with ``collected_at`` may
    repeat within a day, the newest collection counts; without it a day must be unique.
    """
    compared = period_comparison(daily_rows(daily, "entity_id", "subscriber_count"), "entity_id", "subscriber_count", period)
    joined = active_entities(entities).select(*_SHOWN).join(compared, "entity_id", "left")
    ready = F.coalesce("is_ready", F.lit(False))
    side = F.when(~ready, "insufficient").when(F.col("delta") > 0, "rising").when(F.col("delta") < 0, "falling")
    return joined.select(
        *_SHOWN,
        side.alias("list"),
        F.coalesce("latest_value", F.lit(0)).alias("latest_count"),
        "latest_date",
        F.when(ready, F.col("comparison_days")).otherwise(F.coalesce("snapshot_count", F.lit(0))).cast("long").alias("snapshot_count"),
        F.coalesce("comparison_days", F.lit(0)).cast("long").alias("comparison_days"),
        (ready & F.col("is_provisional")).alias("is_provisional"),
        F.when(ready, F.lit("ready")).otherwise(F.lit("insufficient")).alias("status"),
        F.col("base_date").alias("comparison_start"),
        F.col("latest_date").alias("comparison_end"),
        F.coalesce("delta", F.lit(0)).alias("delta"),
        F.coalesce("delta_pct", F.lit(0.0)).alias("delta_pct"),
    ).where(F.col("list").isNotNull())


def ranking_list(ranking: DataFrame, name: str) -> DataFrame:
    """One of the lists in its order."""
    if name == "rising":
        return rising(ranking.where(F.col("list") == "rising"))
    if name == "falling":
        return falling(ranking.where(F.col("list") == "falling"))
    return ranking.where(F.col("list") == name)


def entity_overview(entities: DataFrame, daily: DataFrame) -> DataFrame:
    """Active entities with their latest count and the change over their last rows."""
    change = newest_vs_oldest_of_last(daily, "entity_id", "subscriber_count")
    joined = active_entities(entities).select(*_SHOWN).join(change, "entity_id", "left")
    return joined.select(
        *_SHOWN,
        "latest_value",
        "latest_date",
        F.coalesce("weekly_delta", F.lit(0)).alias("weekly_delta"),
        F.coalesce("weekly_delta_pct", F.lit(0.0)).alias("weekly_delta_pct"),
    )


def entity_series(daily: DataFrame, entity_id: int, metric: str = "subscriber_count") -> DataFrame:
    """Chart series of one entity in date order."""
    rows = lookup(daily, "entity_id", entity_id)
    return chart_series(rows, "entity_id", metric, from_start=metric == "subscriber_count").orderBy("date")


def entity_items(items: DataFrame, entity_id: int, order: str = "newest", limit: int = ENTITY_ITEMS) -> DataFrame:
    """The newest items of one entity, shown by date or by views."""
    newest = lookup(items, "entity_id", entity_id).orderBy(*item_order("newest")).limit(limit)
    return newest.orderBy(*item_order(order))
