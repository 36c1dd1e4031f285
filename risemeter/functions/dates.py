"""Day boundaries and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: snapshot days are local days in this zone.
SNAPSHOT_ZONE = "Asia/Tokyo"


def local_day(ts: Column, zone: str = SNAPSHOT_ZONE) -> Column:
    """The calendar day of an instant in ``zone`` (session time zone UTC)."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def monday_of(ts: Column) -> Column:
    """The UTC Monday on or before an instant."""
    return F.to_date(F.date_trunc("week", ts))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, never negative."""
    return F.greatest(F.lit(0), F.datediff(end, start))


def day_gap(a: Column, b: Column) -> Column:
    """Distance in days, whichever date comes first."""
    return F.abs(F.datediff(a, b))


def shift_day(day: Column, days: int) -> Column:
    return F.date_add(day, days)


def publish_cutoff(now: Column, days: int) -> Column:
    """The instant ``days`` before ``now``; ``now`` is always a parameter, never the clock."""
    return now - F.make_dt_interval(F.lit(days))


def release_bucket(published_at: Column, release_date: Column) -> Column:
    """Place an item before, within seven days of (inclusive), or after a release."""
    published = F.try_to_timestamp(published_at.cast("string"))
    release = release_date.cast("timestamp")
    week_end = release + F.make_dt_interval(F.lit(7))
    return (
        F.when(release.isNull() | published.isNull(), "unclassified")
        .when(published < release, "pre_release")
        .when(published <= week_end, "first_7_days")
        .otherwise("after_release")
    )
