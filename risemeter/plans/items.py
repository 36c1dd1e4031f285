"""Trending items and reclassification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.content import CONTENT_TYPES, classify_content
from risemeter.operators.links import catalog_tags, items_with_entities, top_per_group
from risemeter.operators.predicates import fetched_only, growing, is_rankable, needs_metadata, of_types, period_of_mode
from risemeter.operators.ranking import clamp_limit, page_after
from risemeter.operators.snapshots import daily_rows, period_comparison
from risemeter.operators.tallies import counts_of, missing_counts, transitions

# Examples shown per transition, page sizes.
TRANSITION_EXAMPLES = 20
DEFAULT_PAGE = 50
LARGEST_PAGE = 100


def item_trends(item_daily: DataFrame, period: int) -> DataFrame:
    """One trend per item. Rows with ``collected_at`` may repeat within a day, the newest collection counts."""
    return period_comparison(daily_rows(item_daily, "item_id", "view_count"), "item_id", "view_count", period)


def trending_ranked(
    items: DataFrame, entities: DataFrame, item_daily: DataFrame, mode: str | None, types: str | None
) -> DataFrame:
    """Rankable items of the asked types that grew, with their entity.

    Trends come first: few items grow, and only those are brought to their entities.
    """
    trends = growing(item_trends(item_daily, period_of_mode(mode)).where("is_ready"))
    kept = trends.select("item_id", "latest_date", "base_date", "comparison_days", "is_provisional", "delta", "delta_pct")
    return items_with_entities(of_types(items, types).where(is_rankable()).join(kept, "item_id"), entities)


def trending_page(
    items: DataFrame,
    entities: DataFrame,
    item_daily: DataFrame,
    links: DataFrame,
    catalog: DataFrame,
    mode: str | None = "previous",
    types: str | None = "standard",
    limit: int | str | None = None,
    after: tuple[int, int, str] | None = None,
) -> DataFrame:
    """One page of trending items with catalog tags.

    Tags are looked up for the page only. The page holds at most ``LARGEST_PAGE`` rows, so its ids are
    broadcast to filter links and items without moving either.
    """
    size = clamp_limit(limit, DEFAULT_PAGE, LARGEST_PAGE)
    page = page_after(trending_ranked(items, entities, item_daily, mode, types), size, after)
    shown = F.broadcast(page.select("item_id"))
    tags = catalog_tags(links.join(shown, "item_id", "left_semi"), items.join(shown, "item_id", "left_semi"), catalog)
    return page.join(tags, "item_id", "left")


@dataclass
class Reclassification:
    """Planned changes of a reclassification; every field is lazy."""

    updates: DataFrame
    failures: DataFrame
    changes: DataFrame

    def transitions(self) -> DataFrame:
        return transitions(self.changes)

    def examples(self, n: int = TRANSITION_EXAMPLES) -> DataFrame:
        changed = self.changes.where(F.col("before") != F.col("after"))
        return top_per_group(changed, ["before", "after"], [F.asc("item_id")], n)

    def counts(self) -> DataFrame:
        before = counts_of(self.changes, "before", CONTENT_TYPES).select(F.lit("before").alias("at"), *CONTENT_TYPES)
        after = counts_of(self.changes, "after", CONTENT_TYPES).select(F.lit("after").alias("at"), *CONTENT_TYPES)
        return before.unionByName(after)


def reclassify(items: DataFrame, entities: DataFrame, metadata: DataFrame, refresh: bool = False) -> Reclassification:
    """Classify items again from stored or newly fetched metadata.

    ``metadata`` (item_id, duration_seconds, live_flag, live_details) holds what was fetched. An
    item that lacks metadata and was not fetched fails. With ``refresh`` only fetched items are
    updated. An item that is already live stays live.
    """
    fetched = metadata.select(
        "item_id", F.struct("duration_seconds", "live_flag", "live_details").alias("_new")
    )
    joined = items.join(entities.select("entity_id", "category"), "entity_id", "left").join(fetched, "item_id", "left")
    known = F.col("_new").isNotNull()
    incomplete = F.col("duration_seconds").isNull() | F.col("live_flag").isNull()
    duration = F.when(known, F.col("_new.duration_seconds")).otherwise(F.col("duration_seconds"))
    flag = F.when(known, F.col("_new.live_flag")).otherwise(F.col("live_flag"))
    details = F.col("_new.live_details")
    verdict = classify_content(
        F.col("title"), duration, flag,
        details["actualStartTime"], details["actualEndTime"], details["scheduledStartTime"],
        F.col("category"), F.col("content_type"),
    )
    judged = joined.select(
        "item_id",
        "title",
        F.col("content_type").alias("before"),
        duration.alias("duration_seconds"),
        flag.alias("live_flag"),
        verdict.alias("_verdict"),
        (incomplete & ~known).alias("failed"),
        known.alias("fetched"),
    ).select("*", "_verdict.*").drop("_verdict")
    applies = ~F.col("failed") & (F.col("fetched") | F.lit(not refresh))
    columns = ["item_id", "duration_seconds", "live_flag", "content_type", "reason", "confidence"]
    return Reclassification(
        updates=judged.where(applies).select(*columns),
        failures=judged.where("failed").select("item_id", "title"),
        changes=judged.select(
            "item_id", "title", "before",
            F.when(applies, F.col("content_type")).otherwise(F.col("before")).alias("after"),
            "reason",
        ),
    )


def metadata_requests(items: DataFrame, refresh: bool = False) -> DataFrame:
    return needs_metadata(items, refresh).select("item_id")


def missing_metadata(items: DataFrame) -> DataFrame:
    return missing_counts(items, ["duration_seconds", "live_flag"])


def updates_after_fetch(updates: DataFrame, metadata: DataFrame, refresh: bool) -> DataFrame:
    return fetched_only(updates, metadata, refresh)
