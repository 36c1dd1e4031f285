"""Buzz of catalog entries and the detail view of one entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from risemeter.functions.dates import release_bucket
from risemeter.functions.identity import normalize_type
from risemeter.operators.links import catalog_items, catalog_tags, confirmed_pairs, with_defaults
from risemeter.operators.predicates import growing, is_rankable, of_types
from risemeter.operators.ranking import item_order, momentum_order, trending_order
from risemeter.operators.snapshots import DEFAULT_PERIOD
from risemeter.operators.tallies import catalog_stats, catalog_summary, content_type_counts_once
from risemeter.plans.items import item_trends
from risemeter.session import written

STAT_COLUMNS = ["total_views", "item_count", "recent_views", "recent_item_count", "entity_count"]


def catalog_buzz(catalog: DataFrame, links: DataFrame, items: DataFrame, item_daily: DataFrame) -> DataFrame:
    """Every catalog entry with its buzz statistics, by recent then total views.

    Links, items and trends meet on item_id; only per-entry partial sums travel afterwards.
    """
    slim = items.select("item_id", "entity_id", "view_count", "content_type", "match_status")
    stats = catalog_stats(confirmed_pairs(links, slim, rankable=True), item_trends(item_daily, DEFAULT_PERIOD))
    listed = catalog.select("catalog_id", "name", "maker", "release_date", normalize_type(F.col("type")).alias("type"))
    return with_defaults(listed, stats, "catalog_id", STAT_COLUMNS).orderBy(*momentum_order())


def _with_trends(chosen: DataFrame, item_daily: DataFrame) -> DataFrame:
    wanted = item_daily.join(chosen.select("item_id"), "item_id", "left_semi")
    trends = item_trends(wanted, DEFAULT_PERIOD).select("item_id", "is_ready", "delta", "delta_pct", "comparison_days", "status")
    return chosen.join(trends, "item_id", "left")


def catalog_detail(
    catalog: DataFrame,
    links: DataFrame,
    items: DataFrame,
    entities: DataFrame,
    item_daily: DataFrame,
    catalog_id: int,
    types: str | None = "standard",
    sort: str = "rising",
) -> DataFrame:
    """Confirmed items of one entry with trend, tags and release bucket in the asked order.

    The items of the entry are written once: counters, links and tags are looked up for them, by joins that follow
    from their number, and not by sorting all tables in one stage.
    """
    chosen = written(of_types(catalog_items(links, items, entities, catalog_id), types), "detail-items")
    shown = _with_trends(chosen, item_daily)
    shown = shown.withColumn("delta", F.coalesce("delta", F.lit(0))).withColumn("delta_pct", F.coalesce("delta_pct", F.lit(0.0)))
    release = catalog.where(F.col("catalog_id") == catalog_id).select("catalog_id", "release_date")
    ids = chosen.select("item_id")
    tags = catalog_tags(links.join(ids, "item_id", "left_semi"), items.join(ids, "item_id", "left_semi"), catalog)
    rows = (
        shown.join(release, "catalog_id", "left")
        .withColumn("release_bucket", release_bucket(F.col("published_at"), F.col("release_date")))
        .join(tags, "item_id", "left")
    )
    if sort == "rising":
        return growing(rows.where(is_rankable())).orderBy(*trending_order())
    return rows.orderBy(*item_order(sort))


def catalog_detail_counts(links: DataFrame, items: DataFrame, entities: DataFrame, catalog_id: int) -> DataFrame:
    return content_type_counts_once(catalog_items(links, items, entities, catalog_id))


def catalog_detail_summary(
    links: DataFrame, items: DataFrame, entities: DataFrame, item_daily: DataFrame, catalog_id: int, now: Column
) -> DataFrame:
    chosen = written(catalog_items(links, items, entities, catalog_id), "detail-items")
    wanted = item_daily.join(chosen.select("item_id"), "item_id", "left_semi")
    return catalog_summary(chosen, item_trends(wanted, DEFAULT_PERIOD), now)
