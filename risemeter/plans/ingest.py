"""Daily collection of entity and item snapshots from landed payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.content import classify_content
from risemeter.operators.links import unlinked_items
from risemeter.operators.matching import index_catalog, judged_pairs, title_hits
from risemeter.operators.tallies import run_metrics
from risemeter.session import checkpointed
from risemeter.sources.sinks import (
    ITEM_COLUMNS,
    apply_actions,
    mention_changes,
    new_snapshots,
    rebuilt_mentions,
    refreshed_metadata,
    replaced_auto_links,
    snapshot_outcome,
    status_after_linking,
    upsert_actions,
)


def resolve_handles(entities: DataFrame, handle_stats: DataFrame) -> DataFrame:
    """Fill external id, name and picture of active entities that only have a handle.

    ``handle_stats`` are statistics rows with the ``handle`` they were asked for.
    """
    answers = handle_stats.groupBy("handle").agg(
        F.max(F.struct("external_id", "name", "thumbnail_url")).alias("_found")
    )
    joined = entities.join(answers, "handle", "left")
    takes = F.col("active") & F.col("external_id").isNull() & F.col("_found").isNotNull()
    filled = ["external_id", "name", "thumbnail_url"]
    return joined.select(
        *[
            F.when(takes, F.col(f"_found.{c}")).otherwise(F.col(c)).alias(c) if c in filled else F.col(c)
            for c in entities.columns
        ],
        F.coalesce(takes, F.lit(False)).alias("resolved"),
    )


@dataclass
class EntityIngest:
    entities: DataFrame
    snapshots: DataFrame
    outcome: DataFrame
    metrics: DataFrame


def ingest_entity_snapshots(entities: DataFrame, stored: DataFrame, stats: DataFrame, day: str) -> EntityIngest:
    """Refresh entities and plan the day's snapshots from statistics rows."""
    requested = entities.where(F.col("active") & F.col("external_id").isNotNull())
    known = stats.join(requested.select("external_id", "entity_id"), "external_id")
    counters = ["subscriber_count", "view_count", "video_count"]
    incoming = known.select("entity_id", F.lit(day).cast("date").alias("date"), *counters)
    today = stored.where(F.col("date") == F.lit(day).cast("date"))
    return EntityIngest(
        entities=refreshed_metadata(entities, stats),
        snapshots=new_snapshots(today, incoming, "entity_id", F.struct(*counters)),
        outcome=snapshot_outcome(today, incoming, "entity_id"),
        metrics=run_metrics(requested, stats, "external_id"),
    )


def classified_items(uploads: DataFrame, stats: DataFrame, entities: DataFrame) -> DataFrame:
    """Uploads of active entities with counters and content class; uploads without counters drop out.

    Classification here does not know the stored type, so an archived live item may change type.
    """
    rows = uploads.join(stats, "item_id").join(
        entities.where("active").select("entity_id", "category"), "entity_id"
    )
    details = F.col("live_details")
    verdict = classify_content(
        F.col("title"), F.col("duration_seconds"), F.col("live_flag"),
        details["actualStartTime"], details["actualEndTime"], details["scheduledStartTime"],
        F.col("category"), F.lit(None).cast("string"),
    )
    return rows.withColumn("_verdict", verdict).select(
        "item_id", "entity_id", "title", "thumbnail_url", "published_at",
        "view_count", "like_count", "comment_count", "duration_seconds", "live_flag",
        F.col("_verdict.content_type").alias("content_type"),
        F.col("_verdict.reason").alias("content_type_reason"),
        F.col("_verdict.confidence").alias("content_type_confidence"),
    )


@dataclass
class ItemIngest:
    actions: DataFrame
    items: DataFrame
    snapshots: DataFrame
    links: DataFrame
    mentions: DataFrame
    mention_actions: DataFrame
    review: DataFrame


def ingest_items(
    entities: DataFrame,
    items: DataFrame,
    item_snapshots: DataFrame,
    links: DataFrame,
    mentions: DataFrame,
    catalog: DataFrame,
    uploads: DataFrame,
    stats: DataFrame,
    day: str,
) -> ItemIngest:
    """Classify, upsert, snapshot, link and mention the day's uploads in one set-based pass.

    The day's rows and their matches are checkpointed, as several results are made from them.
    Stored items are split by the incoming ids: the few that came in again are compared, all
    others pass through without being shuffled while the ids are small enough to broadcast.
    """
    spark = items.sparkSession
    incoming = checkpointed(
        classified_items(uploads, stats, entities).withColumn("match_status", F.lit("pending")), spark
    )
    ids = incoming.select("item_id")
    columns = [c for c in incoming.columns if c != "item_id"]
    stored = items.select("item_id", *columns)
    actions = upsert_actions(stored.join(ids, "item_id", "left_semi"), incoming, ["item_id"], ITEM_COLUMNS)
    collected = apply_actions(actions, ["item_id"], columns, keep=["match_status"])

    today = F.lit(day).cast("date")
    counters = ["view_count", "like_count", "comment_count"]
    rows = incoming.select("item_id", today.alias("date"), *counters)
    snapshots = new_snapshots(item_snapshots.where(F.col("date") == today), rows, "item_id", F.struct(*counters))

    index = index_catalog(catalog)
    pairs = checkpointed(judged_pairs(title_hits(incoming.select("item_id", "title"), index), index), spark)
    columns_of_link = ["item_id", "catalog_id", "method", "confidence"]
    linked = replaced_auto_links(
        links.select(*columns_of_link), pairs.where("is_match").select(*columns_of_link), collected
    )
    others = stored.join(ids, "item_id", "left_anti")
    final_items = others.unionByName(status_after_linking(collected, linked))
    rebuilt = rebuilt_mentions(linked, final_items)
    review = unlinked_items(collected.select("item_id"), linked).join(
        pairs.where("is_ambiguous").select("item_id", "catalog_id"), "item_id"
    )
    return ItemIngest(
        actions=actions,
        items=final_items,
        snapshots=snapshots,
        links=linked,
        mentions=rebuilt,
        mention_actions=mention_changes(mentions, rebuilt),
        review=review,
    )
