"""Seeding and upkeep of catalog entries, entities and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.identity import normalize_type, with_identity_key
from risemeter.functions.text import catalog_terms
from risemeter.operators.links import by_id_else_handle, by_name_or_key
from risemeter.operators.sets import last_per_name

UPDATABLE = [
    "name", "maker", "type", "release_date", "short_name", "series", "aliases", "unique_aliases",
    "ambiguous_aliases", "resolving_keywords", "exclude_terms", "source_url", "official_url",
]


def plan_catalog_upsert(
    catalog: DataFrame, *seed_lists: DataFrame, reviewed_aliases: DataFrame | None = None
) -> DataFrame:
    """Seeds (one per name) with ``action`` insert or update and the ``existing_id`` they update.

    A seed updates the first entry of equal name or identity key. Of several new seeds with one
    identity key the first is inserted and the others update it.
    """
    seeds = with_identity_key(last_per_name(*seed_lists), reviewed_aliases)
    known = with_identity_key(catalog, reviewed_aliases).select("catalog_id", "name", "identity_key")
    found = by_name_or_key(seeds, known, "name")
    joined = seeds.join(found, "name", "left")
    first = joined.where(F.col("existing_id").isNull()).groupBy("identity_key").agg(
        F.min(F.struct("position", "name")).alias("_first")
    )
    is_first = F.col("existing_id").isNull() & (F.struct("position", "name") == F.col("_first"))
    action = F.when(F.coalesce(is_first, F.lit(False)), "insert").otherwise("update")
    return joined.join(first, "identity_key", "left").withColumn("action", action).drop("_first")


def apply_catalog_upsert(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """The catalog after the upsert; fields a seed leaves out keep their old values.

    The last seed of an entry wins per field. New entries have a NULL id until stored.
    """
    fields = [c for c in UPDATABLE if c in plan.columns]
    typed = plan.withColumn("type", normalize_type(F.col("type"))) if "type" in fields else plan
    target = F.when(F.col("existing_id").isNotNull(), F.col("existing_id").cast("string")).otherwise(F.col("identity_key"))
    merged = typed.groupBy(target.alias("_target")).agg(
        F.max("existing_id").alias("catalog_id"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c) for c in fields],
    ).drop("_target")
    updates = merged.where(F.col("catalog_id").isNotNull()).select("catalog_id", F.struct(*fields).alias("_new"))
    joined = catalog.join(updates, "catalog_id", "left")
    kept = joined.select(
        *[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in catalog.columns]
    )
    return kept.unionByName(merged.where(F.col("catalog_id").isNull()), allowMissingColumns=True)


def upsert_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if(F.col("action") == "insert").alias("inserts"), F.count_if(F.col("action") == "update").alias("updates")
    )


def upsert_entities(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entities after seeding: found by external id, else by handle; others are added with a NULL id."""
    matched = by_id_else_handle(seeds, entities)
    fields = ["external_id", "handle", "name", "category", "active"]
    chosen = matched.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.max_by(F.struct(*fields), "position").alias("_new")
    )
    joined = entities.join(chosen, "entity_id", "left")
    kept = joined.select(
        *[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in entities.columns]
    )
    added = matched.where(F.col("entity_id").isNull()).select("entity_id", *fields)
    return kept.unionByName(added, allowMissingColumns=True)


def rename_and_deactivate(entities: DataFrame, renames: DataFrame, deactivated: DataFrame) -> DataFrame:
    """Replace handles by the (handle, new_handle) map, then switch off the entities of listed handles."""
    chosen = renames.groupBy("handle").agg(F.max("new_handle").alias("new_handle"))
    renamed = entities.join(chosen, "handle", "left").withColumn("handle", F.coalesce("new_handle", "handle")).drop("new_handle")
    off = deactivated.select("handle").distinct().withColumn("_off", F.lit(True))
    switched = renamed.join(off, "handle", "left")
    return switched.withColumn("active", F.col("active") & F.col("_off").isNull()).select(*entities.columns)


def suggest_aliases(catalog: DataFrame) -> DataFrame:
    """Alias suggestions from what an entry already has; never approved by themselves."""
    terms = catalog_terms(F.array("name", "short_name"), F.col("aliases"))
    return catalog.select(
        "catalog_id", "name", "maker", "type", "short_name",
        terms.alias("aliases"),
        F.coalesce("exclude_terms", F.array().cast("array<string>")).alias("exclude_terms"),
        F.lit(False).alias("approved"),
        F.lit("heuristic").alias("source"),
    )


def apply_aliases(catalog: DataFrame, approved: DataFrame) -> DataFrame:
    """Catalog with short name, aliases and exclusions replaced by approved suggestions."""
    fields = ["short_name", "aliases", "exclude_terms"]
    latest = approved.groupBy("catalog_id").agg(F.max_by(F.struct(*fields), "position").alias("_new"))
    joined = catalog.join(latest, "catalog_id", "left")
    given = F.col("_new").isNotNull()
    return joined.select(
        *[
            F.when(given, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in catalog.columns
        ]
    )
