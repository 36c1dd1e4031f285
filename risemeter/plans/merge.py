"""Merging duplicate catalog entries and reporting on duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from risemeter.functions.identity import with_identity_key
from risemeter.functions.misc import fill_missing
from risemeter.operators.links import conflicts, newest_mentions, first_votes, preferred_links
from risemeter.operators.predicates import is_confirmed, is_rankable
from risemeter.operators.sets import added_strings, rekey, union_strings
from risemeter.operators.tallies import child_counts, residual_references

SCALARS = ["short_name", "series", "thumbnail_url", "source_url", "official_url"]
LISTS = ["aliases", "unique_aliases", "ambiguous_aliases", "resolving_keywords", "exclude_terms"]


def validate_groups(groups: DataFrame, catalog: DataFrame, reviewed_aliases: DataFrame | None = None) -> DataFrame:
    """Each (canonical_id, duplicate_id) with ``ok`` and ``reason``.

    Both rows must exist, share the identity key and not name different series. A group whose
    duplicate is gone counts as merged already.
    """
    keyed = with_identity_key(catalog, reviewed_aliases).select("catalog_id", "identity_key", "series")

    def side(name: str) -> DataFrame:
        return keyed.select(
            F.col("catalog_id").alias(f"{name}_id"), F.struct("identity_key", "series").alias(f"_{name}")
        )

    joined = groups.join(side("canonical"), "canonical_id", "left").join(side("duplicate"), "duplicate_id", "left")
    a, b = F.col("_canonical"), F.col("_duplicate")
    both_series = (a["series"] != "") & (b["series"] != "") & (a["series"] != b["series"])
    reason = (
        F.when(a.isNotNull() & b.isNull(), "already merged")
        .when(a.isNull() | b.isNull(), "machine row missing")
        .when(a["identity_key"] != b["identity_key"], "machine identity differs")
        .when(F.coalesce(both_series, F.lit(False)), "series differs")
        .otherwise("same normalized machine identity")
    )
    ok = F.col("reason").isin("already merged", "same normalized machine identity")
    return joined.select("canonical_id", "duplicate_id", reason.alias("reason")).withColumn("ok", ok)


def folded_catalog(catalog: DataFrame, groups: DataFrame) -> DataFrame:
    """Catalog with duplicates removed and their metadata folded into the canonical rows.

    Scalars keep the canonical value where there is one, lists are united. ``groups`` may carry
    reviewed ``name``, ``maker``, ``type`` and ``release_date`` for the canonical row.
    """
    reviewed = [c for c in ("name", "maker", "type", "release_date") if c in groups.columns]
    payload = catalog.select(F.col("catalog_id").alias("duplicate_id"), *[F.col(c).alias(f"_d_{c}") for c in SCALARS + LISTS])
    # An entry may absorb several duplicates: the first value by duplicate id fills a scalar, and
    # lists follow one another in that order. Both are bounded by the reviewed groups of one entry.
    folded = groups.join(payload, "duplicate_id").groupBy(F.col("canonical_id").alias("catalog_id")).agg(
        *[F.min_by(f"_d_{c}", F.when(F.col(f"_d_{c}").isNotNull(), F.col("duplicate_id"))).alias(f"_d_{c}") for c in SCALARS],
        *[F.sort_array(F.collect_list(F.struct("duplicate_id", f"_d_{c}"))).alias(f"_d_{c}") for c in LISTS],
        *[F.min_by(c, "duplicate_id").alias(f"_r_{c}") for c in reviewed],
        F.lit(True).alias("_absorbs"),
    )
    kept = catalog.join(groups.select(F.col("duplicate_id").alias("catalog_id")), "catalog_id", "left_anti")
    joined = kept.join(folded, "catalog_id", "left")
    none = F.array().cast("array<string>")
    out = []
    for c in catalog.columns:
        if c in SCALARS:
            value = fill_missing(F.col(c), F.col(f"_d_{c}"))
        elif c in LISTS:
            absorbed = F.flatten(F.transform(F.col(f"_d_{c}")[f"_d_{c}"], lambda d: F.coalesce(d, none)))
            value = F.when(F.col("_absorbs"), union_strings(F.col(c), absorbed)).otherwise(F.col(c))
        elif c in reviewed:
            value = F.when(F.col("_absorbs"), F.col(f"_r_{c}")).otherwise(F.col(c))
        else:
            value = F.col(c)
        out.append(value.alias(c))
    return joined.select(*out)


def _affected(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ids in any group, and all other rows, which a merge must not change."""
    ids = groups.select(F.explode(F.array("canonical_id", "duplicate_id")).alias("catalog_id")).distinct()
    return rows.join(ids, "catalog_id", "left_semi"), rows.join(ids, "catalog_id", "left_anti")


@dataclass
class Merged:
    catalog: DataFrame
    links: DataFrame
    mentions: DataFrame
    votes: DataFrame
    judgments: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def pending_groups(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Groups whose duplicate still exists, so that a repeated merge changes nothing."""
    present = catalog.select(F.col("catalog_id").alias("duplicate_id"))
    return groups.join(present, "duplicate_id", "left_semi")


def merge_catalog(
    catalog: DataFrame, links: DataFrame, mentions: DataFrame, votes: DataFrame, judgments: DataFrame, groups: DataFrame
) -> Merged:
    """New versions of the catalog and its four child tables after merging ``groups``.

    Only rows of merged ids are re-keyed and de-duplicated; everything else passes through
    without a shuffle of its own. Refuse groups that ``validate_groups`` rejects before calling.
    """
    groups = pending_groups(groups, catalog)
    voted = votes.withColumnRenamed("target_id", "catalog_id")

    def merged(rows: DataFrame, rule) -> DataFrame:
        hit, rest = _affected(rows, groups)
        moved = rekey(hit, groups).drop("was_duplicate")
        return rest.unionByName(rule(moved))

    def vote_rule(rows: DataFrame) -> DataFrame:
        return first_votes(rows.withColumnRenamed("catalog_id", "target_id")).withColumnRenamed("target_id", "catalog_id")

    return Merged(
        catalog=folded_catalog(catalog, groups),
        links=merged(links, preferred_links),
        mentions=merged(mentions, newest_mentions),
        votes=merged(voted, vote_rule).withColumnRenamed("catalog_id", "target_id"),
        judgments=rekey(judgments, groups).drop("was_duplicate"),
    )


def merge_problems(merged: dict[str, DataFrame], groups: DataFrame) -> DataFrame:
    """Rows that show a failed merge: references left on removed ids, or a missing canonical row."""
    removed = groups.select(F.col("duplicate_id").alias("catalog_id"))
    children = {
        "catalog": merged["catalog"],
        "links": merged["links"],
        "mentions": merged["mentions"],
        "votes": merged["votes"].withColumnRenamed("target_id", "catalog_id"),
        "judgments": merged["judgments"],
    }
    residual = residual_references(removed, children).where(F.col("rows") > 0)
    kept = groups.select(F.col("canonical_id").alias("catalog_id")).distinct()
    missing = kept.join(merged["catalog"].select("catalog_id"), "catalog_id", "left_anti").agg(
        F.count(F.lit(1)).alias("rows")
    ).where(F.col("rows") > 0).select(F.lit("canonical").alias("child"), "rows")
    return residual.unionByName(missing)


def merge_preview(
    links: DataFrame, items: DataFrame, mentions: DataFrame, votes: DataFrame, judgments: DataFrame, groups: DataFrame
) -> DataFrame:
    """Counts before and after per group for the four child tables.

    The rows of a canonical entry are counted once, however many duplicates it absorbs: every table is
    counted per (entry, key), a duplicate's keys are marked where the canonical entry holds them too,
    and the sums of both meet per group. So the work grows with the rows, not with rows times duplicates.
    """
    pair = ["canonical_id", "duplicate_id"]
    # A pair listed several times counts its rows as often.
    planned = groups.groupBy(*pair).agg(F.count(F.lit(1)).alias("_times"))
    # The canonical entry itself stands beside its duplicates, without a duplicate id.
    entries = planned.select(*pair, F.col("duplicate_id").alias("catalog_id")).unionByName(
        planned.select("canonical_id").distinct().select(
            "canonical_id", F.lit(None).cast(planned.schema["duplicate_id"].dataType).alias("duplicate_id"),
            F.col("canonical_id").alias("catalog_id"),
        )
    )

    def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
        per_key = rows.groupBy("catalog_id", key).agg(F.count(F.lit(1)).alias("_n")).join(entries, "catalog_id")
        held = F.max(F.col("duplicate_id").isNull()).over(Window.partitionBy("canonical_id", key))
        sums = per_key.withColumn("_held", held).groupBy(*pair).agg(
            F.sum("_n").alias("_rows"),
            F.count(F.lit(1)).alias("_keys"),
            F.sum(F.when(F.col("_held"), F.col("_n"))).alias("_held_rows"),
            F.count_if("_held").alias("_held_keys"),
        )
        kept = sums.where(F.col("duplicate_id").isNull()).select(
            "canonical_id", F.col("_rows").alias("_kept_rows"), F.col("_keys").alias("_kept_keys")
        )
        joined = planned.join(sums, pair, "left").join(kept, "canonical_id", "left")
        rows_here, keys, held_rows, held_keys, kept_rows, kept_keys = (
            F.coalesce(c, F.lit(0)) for c in ("_rows", "_keys", "_held_rows", "_held_keys", "_kept_rows", "_kept_keys")
        )
        return joined.select(
            *pair,
            ((kept_rows + rows_here) * F.col("_times")).alias(f"{name}_before"),
            (kept_keys + keys - held_keys).alias(f"{name}_after"),
            (rows_here * F.col("_times")).alias(f"{name}_to_move"),
            (held_rows * F.col("_times")).alias(f"{name}_shared"),
        )

    rankable = links.join(items.select("item_id", "match_status", "content_type"), "item_id").where(
        is_confirmed() & is_rankable()
    )
    parts = [
        counted(links, "item_id", "links"),
        counted(mentions, "item_id", "mentions"),
        counted(votes.withColumnRenamed("target_id", "catalog_id"), "voter_id", "votes"),
        counted(judgments, "judgment_id", "judgments").select(*pair, "judgments_to_move"),
        counted(rankable, "item_id", "rankable").select(*pair, "rankable_after"),
    ]
    out = groups.select(*pair)
    for part in parts:
        out = out.join(part, pair, "left")
    counts = [c for c in out.columns if c not in pair]
    return out.select(*pair, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def duplicate_report(
    catalog: DataFrame, links: DataFrame, mentions: DataFrame, votes: DataFrame, judgments: DataFrame, ids: list[int]
) -> DataFrame:
    """Inspected entries with the row counts of their children."""
    chosen = catalog.where(F.col("catalog_id").isin(ids))

    def of(rows: DataFrame, key: str) -> tuple[DataFrame, str]:
        return rows.where(F.col("catalog_id").isin(ids)), key

    counts = child_counts(
        chosen,
        {
            "links": of(links, "item_id"),
            "mentions": of(mentions, "item_id"),
            "votes": of(votes.withColumnRenamed("target_id", "catalog_id"), "voter_id"),
            "judgments": of(judgments, "judgment_id"),
        },
    )
    return chosen.select("catalog_id", "name", "maker", "type", "release_date").join(counts, "catalog_id")


def planned_moves(rows: DataFrame, key: str, canonical_id: int, duplicate_id: int) -> DataFrame:
    """Rows of the duplicate with ``conflict`` where the canonical entry already holds the key."""
    canonical = rows.where(F.col("catalog_id") == canonical_id)
    duplicate = rows.where(F.col("catalog_id") == duplicate_id)
    clash = conflicts(duplicate, canonical, key).select(key).distinct().withColumn("conflict", F.lit(True))
    return duplicate.join(clash, key, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def alias_change(catalog: DataFrame, canonical_id: int, duplicate_id: int, extra: list[str]) -> DataFrame:
    """Aliases of the canonical entry before and after a merge and the ones added."""
    pair = catalog.where(F.col("catalog_id").isin([canonical_id, duplicate_id])).agg(
        F.max(F.when(F.col("catalog_id") == canonical_id, F.col("aliases"))).alias("before"),
        F.max(F.when(F.col("catalog_id") == duplicate_id, F.col("name"))).alias("_name"),
    )
    names = F.filter(F.array("_name", *[F.lit(e) for e in extra]), lambda t: t.isNotNull() & (t != ""))
    after = union_strings(F.col("before"), names)
    return pair.select(
        F.coalesce("before", F.array().cast("array<string>")).alias("before"),
        after.alias("after"),
        added_strings(after, F.col("before")).alias("added"),
    )
