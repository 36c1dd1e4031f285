"""Table updates. Each function returns the new rows or the new table; writers come last.

Parquet has no in-place update, so an update is a new version of the table: what stays, found by
anti join, united with what is new. Keys drive all joins, and each side holds one row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from risemeter.operators.links import first_by
from risemeter.operators.predicates import AUTO_METHODS, EXCLUDED_METHOD, MANUAL_METHODS

# Columns whose change makes an item or a mention stale.
ITEM_COLUMNS = [
    "title", "thumbnail_url", "view_count", "like_count", "comment_count", "content_type",
    "content_type_reason", "content_type_confidence", "duration_seconds", "live_flag",
]
# Files that an append adds to a day at most.
DAY_FILES = 4
MENTION_COLUMNS = ["title", "view_count", "like_count", "comment_count", "published_at"]


def new_snapshots(existing: DataFrame, incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """Incoming rows whose (key, date) is not stored yet; the first one per (key, date)."""
    first = first_by(incoming, [key, "date"], order)
    return first.join(existing.select(key, "date"), [key, "date"], "left_anti")


def snapshot_outcome(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """How many incoming rows are inserted and how many skipped as already present."""
    stored = existing.select(key, "date").distinct().withColumn("_stored", F.lit(True))
    per_key = incoming.groupBy(key, "date").agg(F.count(F.lit(1)).alias("_n")).join(stored, [key, "date"], "left")
    inserted = F.count_if(F.col("_stored").isNull())
    return per_key.agg(inserted.alias("inserted"), (F.coalesce(F.sum("_n"), F.lit(0)) - inserted).alias("skipped"))


def _differs(columns: list[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    return ~same


def upsert_actions(
    existing: DataFrame, incoming: DataFrame, keys: list[str], compared: list[str]
) -> DataFrame:
    """Full outer join of both versions with ``action`` insert / update / unchanged / absent."""
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("old"))
    new = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("new"))
    joined = old.join(new, keys, "full_outer")
    return joined.withColumn(
        "action",
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), "absent")
        .when(_differs(compared), "update")
        .otherwise("unchanged"),
    )


def apply_actions(actions: DataFrame, keys: list[str], columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The table after the upsert. Columns in ``keep`` stay as stored unless the row is inserted."""
    keep = keep or []
    takes_new = F.col("action").isin("insert", "update")

    def value(c: str) -> Column:
        condition = F.col("action") == "insert" if c in keep else takes_new
        return F.when(condition, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return actions.select(*keys, *[value(c) for c in columns])


def refreshed_metadata(entities: DataFrame, stats: DataFrame) -> DataFrame:
    """Entities with the name and picture of the latest statistics; ``refreshed`` marks changes."""
    latest = stats.groupBy("external_id").agg(F.max_by(F.struct("name", "thumbnail_url"), "name").alias("_new"))
    joined = entities.join(latest, "external_id", "left")
    known = F.col("_new").isNotNull()
    changed = known & ~(
        F.col("_new.name").eqNullSafe(F.col("name")) & F.col("_new.thumbnail_url").eqNullSafe(F.col("thumbnail_url"))
    )
    others = [c for c in entities.columns if c not in ("name", "thumbnail_url")]
    return joined.select(
        *others,
        F.when(known, F.col("_new.name")).otherwise(F.col("name")).alias("name"),
        F.when(known, F.col("_new.thumbnail_url")).otherwise(F.col("thumbnail_url")).alias("thumbnail_url"),
        changed.alias("refreshed"),
    )


def replaced_auto_links(links: DataFrame, matches: DataFrame, items: DataFrame) -> DataFrame:
    """All links after a new matching of ``items``: automatic ones replaced, manual ones kept.

    Items with a manual status are left alone, and a match never doubles a manual link.
    ``matches`` and ``links`` have (item_id, catalog_id, method, confidence).
    """
    open_items = items.where(~F.col("match_status").isin(MANUAL_METHODS)).select("item_id")
    columns = ["item_id", "catalog_id", "method", "confidence"]
    fresh = matches.join(open_items, "item_id", "left_semi")
    manual = links.where(F.col("method").isin(MANUAL_METHODS)).select("item_id", "catalog_id")
    fresh = fresh.join(manual, ["item_id", "catalog_id"], "left_anti")
    kept = links.where(~F.col("method").isin(AUTO_METHODS)).unionByName(
        links.where(F.col("method").isin(AUTO_METHODS)).join(open_items, "item_id", "left_anti")
    )
    return kept.select(*columns).unionByName(fresh.select(*columns))


def status_after_linking(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items with matched / unmatched from their links; manual states stay."""
    active = links.where(F.col("method") != EXCLUDED_METHOD).select("item_id").distinct().withColumn("_on", F.lit(True))
    status = (
        F.when(F.col("match_status").isin(MANUAL_METHODS), F.col("match_status"))
        .when(F.col("_on"), "matched")
        .otherwise("unmatched")
    )
    return items.join(active, "item_id", "left").withColumn("match_status", status).drop("_on")


def rebuilt_mentions(links: DataFrame, items: DataFrame) -> DataFrame:
    """All mentions: active links with the counters of their items."""
    return mention_rows(links.where(F.col("method") != EXCLUDED_METHOD), items)


def mention_rows(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One mention per (item, catalog) pair of a known item."""
    columns = ["item_id", "entity_id", "title", "view_count", "like_count", "comment_count", "published_at"]
    return pairs.select("item_id", "catalog_id").distinct().join(items.select(*columns), "item_id")


def mention_changes(mentions: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """What a sync writes: inserts, updates and unchanged rows per (item, catalog)."""
    return upsert_actions(mentions, rebuilt, ["item_id", "catalog_id"], MENTION_COLUMNS)


def latest_votes(votes: DataFrame) -> DataFrame:
    """Last choice per (target, voter)."""
    return votes.groupBy("target_id", "voter_id").agg(
        F.max_by("vote_type", F.struct("created_at", "vote_id")).alias("vote_type"),
        F.min("created_at").alias("created_at"),
    )


def children_of(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent still exists (delete cascade)."""
    return children.join(parents.select(key), key, "left_semi")


def cleared_references(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with the reference set to NULL where the parent is gone."""
    known = parents.select(key).distinct().withColumn("_known", F.lit(True))
    joined = children.join(known, key, "left")
    return joined.select(
        *[F.when(F.col("_known"), F.col(key)).alias(key) if c == key else F.col(c) for c in children.columns]
    )


def without_entities(snapshots: DataFrame, entities: DataFrame, handles: list[str]) -> DataFrame:
    """Snapshots without those of the entities with the listed handles."""
    listed = entities.where(F.col("handle").isin(handles)).select("entity_id")
    return snapshots.join(listed, "entity_id", "left_anti")


def append_by_day(rows: DataFrame, path: str) -> None:
    """Add snapshots to a table with a folder per day; rows of one day are brought together first, so that a day gets few files."""
    rows.repartition("date", F.pmod(F.xxhash64(*rows.columns), F.lit(DAY_FILES))).write.mode("append").partitionBy("date").parquet(path)


def write_digest(digest: DataFrame, path: str) -> None:
    """Replace the digest of its own week only."""
    digest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_of").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_verified(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    folder: str,
    check: Callable[[dict[str, DataFrame]], DataFrame],
) -> dict[str, DataFrame]:
    """Write new versions of several tables under a fresh ``folder`` and verify what was written.

    ``check`` gets the stored tables and returns problem rows. With any problem the versions are
    not handed over, and the tables they were made from are untouched, so readers stay on them.
    """
    for name, rows in tables.items():
        rows.write.mode("error").parquet(f"{folder}/{name}")
    stored = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
    if not check(stored).isEmpty():
        raise ValueError(f"the tables written to {folder} fail their check")
    return stored
