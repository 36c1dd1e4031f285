"""Matching all items again without touching protected or existing links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from risemeter.operators.links import without
from risemeter.operators.matching import index_catalog, judged_pairs, title_hits
from risemeter.operators.predicates import EXCLUDED_METHOD, MANUAL_METHODS
from risemeter.session import checkpointed
from risemeter.sources.sinks import rebuilt_mentions


@dataclass
class Rematch:
    links_to_add: DataFrame
    decisions: DataFrame
    summary: DataFrame
    links: DataFrame
    items: DataFrame

    @property
    def mentions(self) -> DataFrame:
        """All mentions of the items, from their stored and added links; they replace the stored ones."""
        columns = ["item_id", "catalog_id", "method"]
        return rebuilt_mentions(self.links.select(*columns).unionByName(self.links_to_add.select(*columns)), self.items)


def rematch(items: DataFrame, catalog: DataFrame, links: DataFrame) -> Rematch:
    """Links to add, the planned status of every item, and a summary.

    A second run over the result adds nothing. All three come from one pass over the titles,
    whose pairs are checkpointed.
    """
    index = index_catalog(catalog)
    pairs = checkpointed(judged_pairs(title_hits(items, index), index), items.sparkSession)
    stored = links.select("item_id", "catalog_id").distinct()
    to_add = without(pairs.where("is_match"), stored, ["item_id", "catalog_id"]).select(
        "item_id", "catalog_id", "method", "confidence"
    )
    known = stored.withColumn("_stored", F.lit(True))
    per_item = pairs.join(known, ["item_id", "catalog_id"], "left").groupBy("item_id").agg(
        F.count_if("is_match").alias("matches"),
        F.count_if(F.col("is_match") & F.col("_stored").isNull()).alias("links_to_add"),
        F.count_if("is_ambiguous").alias("ambiguous_entries"),
    )
    manual = F.col("method").isin(MANUAL_METHODS)
    existing = links.groupBy("item_id").agg(
        F.count_if(manual).alias("preserved_manual"),
        F.count_distinct(F.when(~manual, F.col("catalog_id"))).alias("preserved_auto"),
        F.max(F.col("method") != EXCLUDED_METHOD).alias("_active"),
    )
    joined = items.select("item_id", "match_status").join(per_item, "item_id", "left").join(existing, "item_id", "left")
    counts = ["matches", "links_to_add", "ambiguous_entries", "preserved_manual", "preserved_auto"]
    filled = joined.select(
        "item_id", "match_status", F.coalesce("_active", F.lit(False)).alias("_active"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )
    planned = (
        F.when(F.col("match_status").isin(MANUAL_METHODS), F.col("match_status"))
        .when(F.col("_active") | (F.col("links_to_add") > 0), "matched")
        .when(F.col("ambiguous_entries") > 0, "ambiguous")
        .otherwise("unmatched")
    )
    decisions = filled.select("item_id", *counts, planned.alias("planned_status"))
    return Rematch(to_add, decisions, summarize(decisions, links), links, items)


def summarize(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """Counts over decisions and links as (measure, amount) rows."""
    status = F.col("planned_status")
    totals = decisions.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "ambiguous").alias("ambiguous"),
        F.count_if(status == "unmatched").alias("unmatched"),
        F.coalesce(F.sum("links_to_add"), F.lit(0)).alias("links_to_add"),
    )
    of_links = links.agg(
        F.count(F.lit(1)).alias("existing_links"),
        F.count_if(F.col("method") == EXCLUDED_METHOD).alias("exclusions_preserved"),
    )
    return _long(totals).unionByName(_long(of_links))


def _long(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "measure", "amount")
