"""Daily counter snapshots: latest rows, period comparisons, series.

Every operator starts from rows (key, date, value, ..). ``one_per_day`` comes first where a
key may repeat within a day: it aggregates map-side on (key, date), so a key with very many
rows is spread over its days and shrinks before it moves. Afterwards a key has at most one row
per day, and grouping by key alone is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from risemeter.functions.dates import day_gap, days_between
from risemeter.functions.numbers import delta_percent
from risemeter.session import spread

# Allowed distance in days of the baseline for each comparison period.
PERIOD_WINDOWS = {1: (1, 3), 7: (5, 9), 30: (21, 39), 90: (60, 120)}
DEFAULT_PERIOD = 7
# Fixed value: rows that the entity overview looks back.
OVERVIEW_ROWS = 8


def one_per_day(snapshots: DataFrame, key: str, values: list[str], collected_at: str = "collected_at") -> DataFrame:
    """One row per (key, date): the newest collection wins. ``raw_rows`` counts what was there."""
    newest = F.max(F.struct(F.col(collected_at), *values))
    return (
        snapshots.groupBy(key, "date")
        .agg(newest.alias("_newest"), F.count(F.lit(1)).alias("raw_rows"))
        .select(key, "date", *[F.col(f"_newest.{v}").alias(v) for v in values], "raw_rows")
    )


def daily_rows(snapshots: DataFrame, key: str, value: str) -> DataFrame:
    """``one_per_day`` of raw rows, which tell when they were collected; rows without that column are daily already."""
    return one_per_day(snapshots, key, [value]) if "collected_at" in snapshots.columns else snapshots


def latest_as_of(daily: DataFrame, key: str, values: list[str], reference_day: str | None = None) -> DataFrame:
    """Latest row per key, optionally not after ``reference_day``. NULL values are kept."""
    rows = daily if reference_day is None else daily.where(F.col("date") <= F.lit(reference_day).cast("date"))
    return (
        rows.groupBy(key)
        .agg(F.max(F.struct("date", *values)).alias("_latest"))
        .select(key, F.col("_latest.date").alias("date"), *[F.col(f"_latest.{v}").alias(v) for v in values])
    )


def days_needed(latest: DataFrame, periods: list[int]) -> DataFrame:
    """(date): the latest days themselves, and the days at which the windows of ``periods`` lie before them."""
    day = F.col(latest.columns[0])
    windows = [F.sequence(F.date_add(day, -PERIOD_WINDOWS[p][1]), F.date_add(day, -PERIOD_WINDOWS[p][0])) for p in periods]
    listed = latest.distinct().select(F.explode(F.concat(F.array(day), *windows)).alias("date")).distinct()
    # A comparison on the small side is what lets Spark prune the partitions of the large one at run time.
    return listed.where(F.col("date") > F.lit("0001-01-01").cast("date"))


def period_comparisons(
    daily: DataFrame,
    key: str,
    value: str,
    periods: list[int],
    reference_day: str | None = None,
) -> DataFrame:
    """Compare each key's latest row with the row nearest to ``period`` days before it.

    Nearest means smallest distance on either side, the earlier date on ties; NULL values never
    serve as baseline. A row that makes a comparison ready lies within its window of days, and no row
    outside is nearer. So the latest day and the row count of each key are found first, by an
    aggregate that moves one row per key and task; then only the latest days and the windows
    before them are read again and shuffled, once for all periods. On a table partitioned by day the
    other days are not even read.

    Needs at most one row per (key, date): repeated days that could change a result are refused, with
    an error; ``one_per_day`` resolves them. Output: one row per (key, period).
    """
    rows = daily if reference_day is None else daily.where(F.col("date") <= F.lit(reference_day).cast("date"))
    raw_rows = F.sum("raw_rows") if "raw_rows" in daily.columns else F.count(F.lit(1))
    totals = rows.groupBy(key).agg(F.max("date").alias("_last"), raw_rows.cast("long").alias("_rows"))
    # No more rows than there are calendar days.
    near = rows.join(F.broadcast(days_needed(totals.select("_last"), periods)), "date", "left_semi")
    # The last stage joins and groups by key: its tasks are not merged.
    days = spread(near, key).join(totals, key).groupBy(key, "date", "_last", "_rows").agg(
        F.max(value).alias(value), F.count(F.lit(1)).alias("_same_day")
    )
    repeated = F.raise_error(F.concat(F.lit("several snapshots on one day of key "), F.col(key).cast("string")))
    marked = days.withColumn(value, F.when(F.col("_same_day") > 1, repeated.cast("long")).otherwise(F.col(value)))

    def nearest(period: int) -> Column:
        gap = day_gap(F.col("date"), F.date_add("_last", -period))
        usable = (F.col("date") < F.col("_last")) & F.col(value).isNotNull()
        return F.min(F.when(usable, F.struct(gap.alias("gap"), "date", F.col(value).alias("value"))))

    grouped = marked.groupBy(key).agg(
        F.max("_last").alias("latest_date"),
        F.max(F.when(F.col("date") == F.col("_last"), F.col(value))).alias("latest_value"),
        F.max("_rows").alias("snapshot_count"),
        *[nearest(p).alias(f"_base_{p}") for p in periods],
    )
    choices = [
        F.struct(
            F.lit(p).alias("period"),
            F.lit(PERIOD_WINDOWS[p][0]).alias("low"),
            F.lit(PERIOD_WINDOWS[p][1]).alias("high"),
            F.col(f"_base_{p}.date").alias("date"),
            F.col(f"_base_{p}.value").alias("value"),
        )
        for p in periods
    ]
    by_period = grouped.select(
        key, "latest_date", "latest_value", "snapshot_count", F.explode(F.array(*choices)).alias("_base")
    )
    days = days_between(F.col("_base.date"), F.col("latest_date"))
    ready = (
        F.col("latest_value").isNotNull()
        & F.col("_base.date").isNotNull()
        & days.between(F.col("_base.low"), F.col("_base.high"))
    )
    judged = by_period.select("*", F.coalesce(ready, F.lit(False)).alias("is_ready"), days.alias("_days"))
    is_ready = F.col("is_ready")
    delta = F.when(is_ready, F.col("latest_value") - F.col("_base.value")).otherwise(F.lit(0))
    return judged.select(
        key,
        F.col("_base.period").alias("period"),
        "latest_date",
        "latest_value",
        "snapshot_count",
        F.when(is_ready, F.col("_base.date")).alias("base_date"),
        F.when(is_ready, F.col("_base.value")).alias("base_value"),
        F.when(is_ready, F.col("_days")).otherwise(F.lit(0)).alias("comparison_days"),
        F.when(is_ready, "ready").otherwise("insufficient").alias("status"),
        (is_ready & (F.col("_days") != F.col("_base.period"))).alias("is_provisional"),
        "is_ready",
        delta.cast("long").alias("delta"),
        F.when(is_ready, delta_percent(delta, F.col("_base.value"))).otherwise(F.lit(0.0)).alias("delta_pct"),
    )


def period_comparison(
    daily: DataFrame, key: str, value: str, period: int = DEFAULT_PERIOD, reference_day: str | None = None
) -> DataFrame:
    return period_comparisons(daily, key, value, [period], reference_day).drop("period")


def newest_vs_oldest_of_last(daily: DataFrame, key: str, value: str, rows: int = OVERVIEW_ROWS) -> DataFrame:
    """Newest row against the oldest of the key's last ``rows`` rows, whatever days they span."""
    recent = daily.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))
    ).where(F.col("_rank") <= rows)
    ends = recent.groupBy(key).agg(
        F.max("date").alias("latest_date"),
        F.max_by(value, "date").alias("latest_value"),
        F.min_by(value, "date").alias("oldest_value"),
        F.count(F.lit(1)).alias("_n"),
    )
    delta = F.when(F.col("_n") > 1, F.col("latest_value") - F.col("oldest_value")).otherwise(F.lit(0))
    return ends.select(
        key,
        "latest_date",
        "latest_value",
        delta.cast("long").alias("weekly_delta"),
        delta_percent(delta, F.col("oldest_value")).alias("weekly_delta_pct"),
    )


def latest_vs_first(daily: DataFrame, key: str, value: str) -> DataFrame:
    """Newest row against the first row ever: one aggregation with map-side combine."""
    return (
        daily.groupBy(key)
        .agg(
            F.min("date").alias("first_date"),
            F.max("date").alias("latest_date"),
            F.min_by(value, "date").alias("first_value"),
            F.max_by(value, "date").alias("latest_value"),
        )
        .withColumn("delta", F.col("latest_value") - F.col("first_value"))
    )


def _plotted(daily: DataFrame, key: str, metric: str) -> DataFrame:
    """Rows with a positive metric; all rows of keys that have none."""
    any_positive = F.max(F.col(metric) > 0).over(Window.partitionBy(key))
    marked = daily.withColumn("_any", F.coalesce(any_positive, F.lit(False)))
    return marked.where((F.col(metric) > 0) | ~F.col("_any")).drop("_any")


def chart_series(daily: DataFrame, key: str, metric: str, from_start: bool) -> DataFrame:
    """Series per key: raw value, value since the start (or raw), day-on-day difference."""
    in_order = Window.partitionBy(key).orderBy("date")
    raw = F.col(metric)
    base = F.first(raw).over(in_order) if from_start else F.lit(0)
    return _plotted(daily, key, metric).select(
        key,
        "date",
        raw.alias("raw_value"),
        (raw - base).alias("value"),
        (raw - F.lag(raw, 1).over(in_order)).alias("_diff"),
    ).select(key, "date", "raw_value", "value", F.coalesce("_diff", F.lit(0)).alias("day_diff"))


def series_facts(daily: DataFrame, key: str, metric: str, audience: str = "subscriber_count") -> DataFrame:
    """Audience change over a key's plotted rows, and the inclusive span in days."""
    ends = _plotted(daily, key, metric).groupBy(key).agg(
        F.coalesce(F.max_by(audience, "date"), F.lit(0)).alias("latest_count"),
        F.coalesce(F.min_by(audience, "date"), F.lit(0)).alias("start_count"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("long").alias("span_days"),
    )
    public = (F.col("latest_count") > 0) & (F.col("start_count") > 0)
    delta = F.when(public, F.col("latest_count") - F.col("start_count")).otherwise(F.lit(0))
    percent = F.when(public, delta / F.col("start_count") * 100).otherwise(F.lit(0.0))
    return ends.select(
        key, "latest_count", "start_count", public.alias("is_public"),
        delta.cast("long").alias("delta"), percent.alias("delta_pct"), "span_days",
    )
