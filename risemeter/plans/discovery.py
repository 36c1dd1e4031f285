"""Discovery of entities from search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from risemeter.functions.dates import publish_cutoff
from risemeter.functions.misc import PAGE_ADDRESS
from risemeter.functions.numbers import candidate_score
from risemeter.operators.links import top_per_group, without
from risemeter.operators.ranking import candidate_order

# Default queries and samples kept per candidate.
DEFAULT_QUERIES = ["パチンコ 実践", "パチスロ 実践", "スマスロ 実践", "新台 パチンコ", "新台 スロット"]
SAMPLES = 5
UNKNOWN_TITLE = "Unknown"


def hit_groups(hits: DataFrame, registered: DataFrame, min_items: int) -> DataFrame:
    """Unregistered entities with their distinct items and queries, at least ``min_items`` items.

    One pass: because of the distinct count, Spark first aggregates by (entity, item), so an
    entity with very many hits is spread over its items. The query list is bounded by the
    queries asked.
    """
    fresh = without(hits.where((F.col("external_id") != "") & (F.col("item_id") != "")), registered, "external_id")
    newest = F.max(F.struct("published_at", "item_id", "entity_title"))
    groups = fresh.groupBy("external_id").agg(
        F.count_distinct("item_id").alias("item_count"),
        F.sort_array(F.collect_set("query")).alias("queries"),
        newest.alias("_newest"),
    )
    return groups.where(F.col("item_count") >= min_items).select(
        "external_id", "item_count", "queries", F.size("queries").cast("long").alias("query_count"),
        F.col("_newest.published_at").alias("newest_at"), F.col("_newest.entity_title").alias("entity_title"),
    )


def sample_items(hits: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Newest items per entity; the top-n is taken per task before the shuffle."""
    # A repeated item keeps its last hit, as all hits of one item agree but for the query.
    once = hits.groupBy("external_id", "item_id").agg(
        F.max(F.struct("published_at", "title", "entity_title")).alias("_hit")
    ).select("external_id", "item_id", "_hit.*")
    return top_per_group(once, ["external_id"], [F.desc("published_at"), F.asc("item_id")], n)


def discover_candidates(
    hits: DataFrame, details: DataFrame, registered: DataFrame, now: Column, min_items: int, limit: int | None
) -> DataFrame:
    """Scored candidates, best first, with fallback details where none were fetched; all of them without a ``limit``.

    ``details`` may lack the picture, the description or the publish date; these are NULL then.
    """
    groups = hit_groups(hits, registered, min_items)
    known = [F.col(c) if c in details.columns else F.lit(None).cast("string").alias(c) for c in ("thumbnail_url", "description", "published_at")]
    joined = groups.join(
        details.select("external_id", F.struct("title", "subscriber_count", "view_count", "video_count", *known).alias("_d")),
        "external_id",
        "left",
    )
    scored = joined.select(
        "external_id",
        F.coalesce("_d.title", "entity_title", F.lit(UNKNOWN_TITLE)).alias("title"),
        F.concat(F.lit(PAGE_ADDRESS + "channel/"), "external_id").alias("entity_url"),
        F.col("_d.subscriber_count").alias("subscriber_count"),
        F.coalesce("_d.view_count", F.lit(0)).alias("view_count"),
        F.coalesce("_d.video_count", F.lit(0)).alias("video_count"),
        *[F.col(f"_d.{c}").alias(c) for c in ("thumbnail_url", "description", "published_at")],
        "item_count",
        "queries",
        candidate_score(
            F.col("item_count"), F.col("query_count"), F.col("_d.subscriber_count"),
            F.try_to_timestamp(F.col("newest_at").cast("string")), now,
        ).alias("score"),
    )
    ordered = scored.orderBy(*candidate_order())
    return ordered if limit is None else ordered.limit(limit)


def discovery_report(
    hits: DataFrame, details: DataFrame, registered: DataFrame, now: Column, days: int, min_items: int, limit: int | None
) -> DataFrame:
    """The candidates with their newest items, when they were found, and what was asked for.

    Only hits of the candidates are looked at again; each brings at most ``SAMPLES`` items.
    """
    found = discover_candidates(hits, details, registered, now, min_items, limit)
    fresh = hits.where(F.col("item_id") != "").join(found.select("external_id"), "external_id", "left_semi")
    sample = sample_items(fresh).groupBy("external_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id", "title", "published_at"))), lambda s: s.dropFields("position")).alias("sample_items")
    )
    asked = F.struct(
        F.lit(days).alias("days"), F.lit(min_items).alias("min_items"), search_conditions(now, days).alias("published_after"), F.lit(limit).cast("int").alias("limit")
    )
    return found.join(sample, "external_id", "left").withColumns({"discovered_at": now, "search_conditions": asked})


def search_conditions(now: Column, days: int) -> Column:
    return publish_cutoff(now, days)
