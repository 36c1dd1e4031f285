"""Counts, totals and checks. All are grouped aggregations with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from risemeter.functions.content import CONTENT_TYPES, RANKABLE_TYPES
from risemeter.functions.identity import normalize_type
from risemeter.functions.numbers import share_percent

# Fixed value: share of requested sources that must answer.
SUCCESS_RATE = 0.95


def counts_of(rows: DataFrame, column: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """One zero-filled count column per listed value."""
    return rows.groupBy(*(by or [])).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def content_type_counts(items: DataFrame) -> DataFrame:
    return counts_of(items, "content_type", CONTENT_TYPES)


def content_type_counts_once(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over distinct items."""
    once = rows.groupBy(*(by or []), "item_id").agg(F.min("content_type").alias("content_type"))
    return counts_of(once, "content_type", CONTENT_TYPES, by)


def catalog_stats(pairs: DataFrame, trends: DataFrame) -> DataFrame:
    """Per catalog entry over its distinct items: items, entities, views, recent views, items with a trend.

    ``trends`` has one row per item, so a trend is computed once however many entries link the item.
    """
    joined = pairs.join(trends.select("item_id", "is_ready", "delta"), "item_id", "left")
    ready = F.coalesce("is_ready", F.lit(False))
    gain = F.when(ready, F.greatest(F.lit(0), F.col("delta"))).otherwise(F.lit(0))
    per_entity = joined.groupBy("catalog_id", "entity_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("view_count").alias("views"),
        F.sum(gain).alias("recent"),
        F.count_if(ready).alias("ready"),
    )
    return per_entity.groupBy("catalog_id").agg(
        F.sum("items").alias("item_count"),
        F.count("entity_id").alias("entity_count"),
        F.sum("views").alias("total_views"),
        F.sum("recent").alias("recent_views"),
        F.sum("ready").alias("recent_item_count"),
    )


def catalog_summary(items: DataFrame, trends: DataFrame, now: Column) -> DataFrame:
    """Summary of one entry's confirmed items (every type), each once."""
    joined = items.join(trends.select("item_id", "is_ready", "delta"), "item_id", "left")
    ready = F.coalesce("is_ready", F.lit(False))
    published = F.try_to_timestamp(F.col("published_at").cast("string"))
    return joined.agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col("content_type").isin(RANKABLE_TYPES)).alias("ranking_item_count"),
        F.coalesce(F.sum("view_count"), F.lit(0)).alias("total_views"),
        F.count_if(published >= now - F.make_dt_interval(F.lit(7))).alias("recent_item_count"),
        F.coalesce(
            F.sum(F.when(ready, F.greatest(F.lit(0), F.col("delta"))).otherwise(F.lit(0))), F.lit(0)
        ).alias("recent_views"),
        F.max("updated_at").alias("last_updated_at"),
        F.min("published_at").alias("period_start"),
        F.max("published_at").alias("period_end"),
    )


def vote_tally(votes: DataFrame, kinds: list[str]) -> DataFrame:
    """Zero-filled counts per target with total and whole-number shares."""
    counts = counts_of(votes, "vote_type", kinds, ["target_id"])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    summed = counts.withColumn("total", total)
    return summed.select("*", *[share_percent(F.col(k), F.col("total")).alias(f"{k}_share") for k in kinds])


def buzz_totals(catalog: DataFrame, mentions: DataFrame) -> DataFrame:
    """Views and items per catalog entry from its mentions; entries without any count 0."""
    totals = mentions.groupBy("catalog_id").agg(
        F.sum("view_count").alias("total_views"), F.count(F.lit(1)).alias("item_count")
    )
    return catalog.select("catalog_id", "name", "maker").join(totals, "catalog_id", "left").select(
        "catalog_id", "name", "maker",
        F.coalesce("total_views", F.lit(0)).alias("total_views"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
    )


def duplicate_votes(votes: DataFrame) -> DataFrame:
    """Votes of (target, voter) pairs with several votes, with the pair's count and the kept id.

    One row per vote rather than a list per pair, so that a pair with very many votes does not
    gather in one place.
    """
    keys = ["target_id", "voter_id"]
    counted = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count"), F.max("vote_id").alias("kept_id"))
    return votes.select(*keys, "vote_id").join(counted.where(F.col("duplicate_count") > 1), keys)


def repeated_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once: a uniqueness check passes when this is empty."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def transitions(changes: DataFrame) -> DataFrame:
    """Number of items per (before, after) type, changed ones only."""
    changed = changes.where(F.col("before") != F.col("after"))
    return changed.groupBy("before", "after").agg(F.count(F.lit(1)).alias("items"))


def run_metrics(requested: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Requested, fetched and failed sources and whether the run counts as successful."""
    answered = fetched.select(key).distinct().withColumn("_answered", F.lit(True))
    counts = requested.join(answered, key, "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_answered").alias("fetched")
    )
    rate = F.col("fetched") / F.col("requested")
    return counts.select(
        "requested",
        "fetched",
        (F.col("requested") - F.col("fetched")).alias("failed"),
        F.when(F.col("requested") == 0, F.lit(False)).otherwise(rate >= SUCCESS_RATE).alias("is_successful"),
    )


def catalog_type_counts(catalog: DataFrame) -> DataFrame:
    kinds = catalog.select(F.coalesce(normalize_type(F.col("type")), F.lit("unknown")).alias("kind"))
    return counts_of(kinds, "kind", ["pachinko", "slot", "unknown"])


def release_months(catalog: DataFrame) -> DataFrame:
    """Distinct release months, newest first."""
    month = F.date_format("release_date", "yyyy-MM").alias("month")
    return catalog.where(F.col("release_date").isNotNull()).select(month).distinct().orderBy(F.desc("month"))


def latest_date(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.max("date").alias("latest_date"))


def missing_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def child_counts(catalog: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and distinct keys of every child table per catalog id; absent means 0.

    ``children`` maps a name to (table with catalog_id, key column). Each table is aggregated
    before it is joined, so the joins see one row per catalog id.
    """
    out = catalog.select("catalog_id")
    for name, (table, key) in children.items():
        per_key = table.groupBy("catalog_id", key).agg(F.count(F.lit(1)).alias("_n"))
        counts = per_key.groupBy("catalog_id").agg(
            F.sum("_n").alias(name), F.count(F.lit(1)).alias(f"distinct_{name}")
        )
        out = out.join(counts, "catalog_id", "left")
    filled = [c for c in out.columns if c != "catalog_id"]
    return out.select("catalog_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in filled])


def residual_references(removed: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Rows per child table that still point at a removed catalog id."""
    parts = [
        table.join(removed.select("catalog_id"), "catalog_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("child"), "rows")
        for name, table in children.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
