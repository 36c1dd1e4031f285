"""Row filters and parameter checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from risemeter.functions.content import CATEGORIES, CONTENT_TYPES, RANKABLE_TYPES
from risemeter.functions.identity import normalize_type
from risemeter.functions.misc import is_valid_vote, is_valid_voter
from risemeter.functions.text import trim_space
from risemeter.operators.snapshots import DEFAULT_PERIOD, PERIOD_WINDOWS

# Link states and list sizes.
CONFIRMED_STATUS = "matched"
EXCLUDED_METHOD = "manual_excluded"
MANUAL_METHODS = ["manual", "manual_excluded"]
AUTO_METHODS = ["exact_name", "alias"]
TREND_MODES = {"previous": 1, "7d": 7}
SMALL_SAMPLE = (1, 2)


def is_confirmed(status: str = "match_status", method: str = "method") -> Column:
    """Only status matched counts, and never an excluded link; a manual status does not count."""
    return (F.col(status) == CONFIRMED_STATUS) & (F.col(method) != EXCLUDED_METHOD)


def is_rankable(content_type: str = "content_type") -> Column:
    return F.col(content_type).isin(RANKABLE_TYPES)


def content_types_from(parameter: str | None) -> list[str]:
    """Known types named in a comma list; standard when none is."""
    named = [part.strip() for part in (parameter or "").split(",")]
    return [name for name in named if name in CONTENT_TYPES] or ["standard"]


def of_types(items: DataFrame, parameter: str | None) -> DataFrame:
    return items.where(F.col("content_type").isin(content_types_from(parameter)))


def period_from(parameter: int | str | None) -> int:
    try:
        period = float(DEFAULT_PERIOD if parameter is None else parameter)
    except ValueError:
        return DEFAULT_PERIOD
    return int(period) if period in PERIOD_WINDOWS else DEFAULT_PERIOD


def period_of_mode(mode: str | None) -> int:
    return TREND_MODES.get(mode or "previous", TREND_MODES["previous"])


def catalog_of(catalog: DataFrame, kind: str = "all", month: str = "all") -> DataFrame:
    """Catalog rows of a canonical type and a release month (``YYYY-MM``)."""
    out = catalog
    if kind != "all":
        out = out.where(normalize_type(F.col("type")) == kind)
    if month != "all":
        out = out.where(F.col("release_date").cast("string").startswith(month))
    return out


def ranked_only(stats: DataFrame) -> DataFrame:
    return stats.where(F.coalesce("item_count", F.lit(0)) > 0)


def unranked_only(stats: DataFrame) -> DataFrame:
    return stats.where(F.coalesce("item_count", F.lit(0)) <= 0)


def is_small_sample(item_count: Column) -> Column:
    return F.coalesce(item_count, F.lit(0)).between(*SMALL_SAMPLE)


def search(entities: DataFrame, text: str = "", category: str = "all") -> DataFrame:
    """Name contains the trimmed text in any case; category matches unless ``all``."""
    out = entities if category == "all" else entities.where(F.col("category") == category)
    return out.where(F.contains(F.lower("name"), F.lower(trim_space(F.lit(text)))))


def needs_metadata(items: DataFrame, refresh: bool = False) -> DataFrame:
    if refresh:
        return items
    return items.where(F.col("duration_seconds").isNull() | F.col("live_flag").isNull())


def fetched_only(updates: DataFrame, metadata: DataFrame, required: bool) -> DataFrame:
    return updates.join(metadata.select("item_id"), "item_id", "left_semi") if required else updates


def valid_votes(votes: DataFrame, allowed: list[str]) -> DataFrame:
    return votes.where(is_valid_vote(F.col("vote_type"), allowed) & is_valid_voter(F.col("voter_id")))


def valid_category(category: Column) -> Column:
    return F.coalesce(category.isin(CATEGORIES), F.lit(False))


def with_status(rows: DataFrame, status: str, column: str = "match_status") -> DataFrame:
    return rows.where(F.col(column) == status)


def growing(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("delta") > 0)


def mentioning(items: DataFrame, phrases: list[str], column: str = "title") -> DataFrame:
    """Items whose text holds any of the phrases as written."""
    return items.where(reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(p)) for p in phrases]))
