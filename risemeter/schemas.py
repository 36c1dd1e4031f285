"""Schemas and unique keys of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from risemeter.operators.tallies import repeated_values
from risemeter.session import spread

_LISTS = (
    "aliases ARRAY<STRING>, unique_aliases ARRAY<STRING>, ambiguous_aliases ARRAY<STRING>, "
    "resolving_keywords ARRAY<STRING>, exclude_terms ARRAY<STRING>"
)
_COUNTERS = "view_count BIGINT, like_count BIGINT, comment_count BIGINT"

SCHEMAS = {
    "entities": "entity_id BIGINT, external_id STRING, handle STRING, name STRING, thumbnail_url STRING, category STRING, "
    "active BOOLEAN, created_at TIMESTAMP",
    "entity_snapshots": "entity_id BIGINT, date DATE, subscriber_count BIGINT, view_count BIGINT, video_count BIGINT, "
    "collected_at TIMESTAMP",
    "items": f"item_id STRING, entity_id BIGINT, title STRING, thumbnail_url STRING, published_at STRING, {_COUNTERS}, "
    "content_type STRING, content_type_reason STRING, content_type_confidence INT, duration_seconds BIGINT, "
    "live_flag STRING, match_status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "item_snapshots": f"item_id STRING, date DATE, {_COUNTERS}, collected_at TIMESTAMP",
    "entity_votes": "vote_id BIGINT, target_id BIGINT, voter_id STRING, vote_type STRING, created_at TIMESTAMP",
    "catalog": f"catalog_id BIGINT, name STRING, short_name STRING, {_LISTS}, type STRING, maker STRING, series STRING, "
    "release_date DATE, thumbnail_url STRING, source_url STRING, official_url STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "mentions": f"mention_id BIGINT, catalog_id BIGINT, entity_id BIGINT, item_id STRING, title STRING, {_COUNTERS}, "
    "published_at STRING, updated_at TIMESTAMP",
    "judgments": "judgment_id BIGINT, judgment_key STRING, catalog_id BIGINT, entity_id BIGINT, item_id STRING, title STRING, "
    "entity_name STRING, published_at STRING, source STRING, status STRING, confidence INT, reason STRING, "
    "matched_terms ARRAY<STRING>, raw_response STRING",
    "catalog_votes": "vote_id BIGINT, target_id BIGINT, voter_id STRING, vote_type STRING, created_at TIMESTAMP",
    "digests": "week_of DATE, title STRING, body_markdown STRING, created_at TIMESTAMP",
    "links": "link_id BIGINT, item_id STRING, catalog_id BIGINT, confidence INT, method STRING, created_at TIMESTAMP, "
    "updated_at TIMESTAMP",
}

# Tables whose key combination may occur once; entity votes have none.
UNIQUE_KEYS = {
    "entities": ["external_id"],
    "entity_snapshots": ["entity_id", "date"],
    "items": ["item_id"],
    "item_snapshots": ["item_id", "date"],
    "mentions": ["catalog_id", "item_id"],
    "judgments": ["judgment_key"],
    "catalog_votes": ["target_id", "voter_id"],
    "digests": ["week_of"],
    "links": ["item_id", "catalog_id"],
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def key_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, keys, occurrences) for every repeated unique key; NULL keys never repeat."""
    parts = []
    for name, rows in tables.items():
        keys = UNIQUE_KEYS[name]
        # In the other order, as Spark leaves a repartition out where rows are partitioned in the same way.
        repeated = repeated_values(spread(rows.dropna(subset=keys).select(*keys), *reversed(keys)), keys)
        parts.append(
            repeated.select(F.lit(name).alias("table"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "occurrences")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
