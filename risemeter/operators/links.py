"""Joins of items, entities, catalog and links, and rules that pick one row per key.

Picking a row is a grouped minimum over a struct, not a window: partial aggregation keeps one
candidate per key and task, so a key with very many rows never gathers in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from risemeter.operators.predicates import EXCLUDED_METHOD, is_confirmed, is_rankable

# Rank of link methods when two links of one item fall together.
METHOD_RANK = {"manual": 4, "manual_excluded": 3, "exact_name": 2, "alias": 1}


def link_items(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links with their items."""
    return links.join(items, "item_id")


def confirmed_pairs(links: DataFrame, items: DataFrame, rankable: bool) -> DataFrame:
    """Each confirmed (item, catalog) pair once, with the item's columns.

    The join partitions by item, which also serves the de-duplication, so links move once.
    """
    rows = link_items(links.select("item_id", "catalog_id", "method"), items).where(is_confirmed())
    if rankable:
        rows = rows.where(is_rankable())
    return rows.drop("method").dropDuplicates(["item_id", "catalog_id"])


def catalog_items(links: DataFrame, items: DataFrame, entities: DataFrame, catalog_id: int) -> DataFrame:
    """Confirmed items of one catalog entry with their entities."""
    chosen = links.where(F.col("catalog_id") == catalog_id).select("item_id", "catalog_id", "method")
    rows = chosen.join(items, "item_id").where(is_confirmed()).drop("method").dropDuplicates(["item_id"])
    return rows.join(entities.select("entity_id", F.col("name").alias("entity_name")), "entity_id")


def items_with_entities(items: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select("entity_id", F.col("name").alias("entity_name"), "category")
    return items.join(names, "entity_id")


def catalog_tags(links: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (id, name) tags per item, ordered by id.

    Pairs are made distinct first, so the list of one item is bounded by its catalog entries.
    """
    named = catalog.select("catalog_id", "name")
    pairs = confirmed_pairs(links, items.select("item_id", "match_status", "content_type"), rankable=False)
    return (
        pairs.join(named, "catalog_id")
        .groupBy("item_id")
        .agg(F.sort_array(F.collect_set(F.struct("catalog_id", "name"))).alias("tags"))
    )


def with_defaults(rows: DataFrame, stats: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join that fills the given count columns with 0."""
    joined = rows.join(stats, key, "left")
    return joined.select(
        *[c for c in joined.columns if c not in columns],
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns],
    )


def only_selected(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    return rows.join(selected.select(key), key, "left_semi")


def without(rows: DataFrame, known: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows whose key is absent from ``known``."""
    keys = [keys] if isinstance(keys, str) else keys
    return rows.join(known.select(*keys), keys, "left_anti")


def unlinked_items(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items without any link other than exclusions."""
    return without(items, links.where(F.col("method") != EXCLUDED_METHOD), "item_id")


def by_name_or_key(rows: DataFrame, existing: DataFrame, row_id: str) -> DataFrame:
    """(row_id, existing_id): the first existing row with equal name or equal identity key.

    Two equi joins instead of an OR condition. Only the first id per name and per key can win,
    so the existing side is reduced to one row per value before joining: no pairs multiply.
    """
    by_name = existing.groupBy("name").agg(F.min("catalog_id").alias("existing_id"))
    by_key = existing.groupBy("identity_key").agg(F.min("catalog_id").alias("existing_id"))
    found = rows.join(by_name, "name").select(row_id, "existing_id").unionByName(
        rows.join(by_key, "identity_key").select(row_id, "existing_id")
    )
    return found.groupBy(row_id).agg(F.min("existing_id").alias("existing_id"))


def by_id_else_handle(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """Seeds with ``entity_id`` of the entity of equal external id, else of equal handle.

    ``found_by`` tells which; both are NULL for new entities.
    """
    ids = entities.where(F.col("external_id").isNotNull()).groupBy("external_id").agg(F.min("entity_id").alias("_by_id"))
    handles = entities.where(F.col("handle").isNotNull()).groupBy("handle").agg(F.min("entity_id").alias("_by_handle"))
    joined = seeds.join(ids, "external_id", "left").join(handles, "handle", "left")
    return joined.select(
        *seeds.columns,
        F.coalesce("_by_id", "_by_handle").alias("entity_id"),
        F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_handle").isNotNull(), "handle").alias("found_by"),
    )


def conflicts(duplicate_rows: DataFrame, canonical_rows: DataFrame, key: str) -> DataFrame:
    """Rows of a duplicate whose unique key the canonical entry already holds."""
    return duplicate_rows.join(canonical_rows.select(key), key, "left_semi")


def first_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` value per key."""
    others = [c for c in rows.columns if c not in keys]
    chosen = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return chosen.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def preferred_links(links: DataFrame) -> DataFrame:
    """One link per (item, catalog): an exclusion wins, then method rank, then confidence, then id."""
    rank = F.coalesce(F.create_map(*[F.lit(v) for kv in METHOD_RANK.items() for v in kv])[F.col("method")], F.lit(0))
    excluded = F.col("method") == EXCLUDED_METHOD
    order = F.struct(
        (~excluded).alias("a"),
        F.when(excluded, F.lit(0)).otherwise(-rank).alias("b"),
        F.when(excluded, F.lit(0)).otherwise(-F.col("confidence")).alias("c"),
        F.col("link_id").alias("d"),
    )
    return first_by(links, ["item_id", "catalog_id"], order)


def newest_mentions(mentions: DataFrame) -> DataFrame:
    """One mention per (item, catalog): the most recently updated, the first of equals."""
    order = F.struct(F.negative(F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("a"), F.col("mention_id").alias("b"))
    return first_by(mentions, ["item_id", "catalog_id"], order)


def first_votes(votes: DataFrame) -> DataFrame:
    """One vote per (target, voter): the first one."""
    return first_by(votes, ["target_id", "voter_id"], F.struct("vote_id"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; the row_number limit is pushed below the shuffle by Spark."""
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("position", position).where(F.col("position") <= n)
