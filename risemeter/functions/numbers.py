"""Rounding, percentages and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(x: Column, digits: int) -> Column:
    """Round the exact binary value to ``digits`` decimals, exact ties away from zero.

    Spark's ``round`` works on the shortest decimal form (0.575 becomes 0.58 although the
    double lies below it). ``format_number`` works on the exact value but sends ties to even,
    so exact ties, which need at most ``digits + 1`` binary places, take ``round``.
    """
    scaled = F.abs(x) * float(2 ** (digits + 1))
    exact = F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")
    return F.when(scaled == F.floor(scaled), F.round(x, digits)).otherwise(exact) + F.lit(0.0)


def delta_percent(delta: Column, base: Column) -> Column:
    """Growth in percent with two decimals; 0 when the base is not positive."""
    return F.when(base > 0, fixed(delta / base * 100, 2)).otherwise(F.lit(0.0))


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def share_percent(part: Column, total: Column) -> Column:
    """Whole-number percentage; 0 when there is no total."""
    return F.when(total > 0, round_half_up(part / total * 100)).otherwise(F.lit(0).cast("long"))


def mean_per_item(amount: Column, items: Column) -> Column:
    """Rounded mean; 0 when there are no items."""
    return F.when(items <= 0, F.lit(0).cast("long")).otherwise(round_half_up(amount / items))


def trend_direction(delta: Column, comparison_count: Column) -> Column:
    """none / up / down / flat; a comparison count of at most one shows no trend."""
    return (
        F.when(comparison_count <= 1, "none").when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")
    )


def candidate_score(
    item_count: Column, query_count: Column, subscribers: Column, newest: Column, now: Column
) -> Column:
    """Discovery score from breadth of hits, audience size and recency, three decimals."""
    # 20 per item, 15 per query, 3 per decade of subscribers, 20 - days/3 for
    # recency, 60 days when no publish time is known.
    audience = F.log10(F.coalesce(subscribers, F.lit(0)) + F.lit(1.0)) * 3
    age_ms = F.unix_millis(now) - F.unix_millis(newest)
    days = F.when(F.unix_millis(newest) > 0, F.greatest(F.lit(0.0), age_ms / 86_400_000)).otherwise(F.lit(60.0))
    recency = F.greatest(F.lit(0.0), F.lit(20.0) - days / 3)
    return fixed(item_count * 20 + query_count * 15 + audience + recency, 3)
