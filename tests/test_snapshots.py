"""Period comparisons and series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from risemeter.operators import snapshots as W
from risemeter.sources.sinks import append_by_day
from risemeter.plans.growth import growth_ranking, ranking_list


def daily(spark, pairs):
    rows = [(1, dt.date.fromisoformat(d), v) for d, v in pairs]
    return spark.createDataFrame(rows, "entity_id BIGINT, date DATE, subscriber_count BIGINT")


def compared(spark, pairs, period, reference=None):
    row = W.period_comparison(daily(spark, pairs), "entity_id", "subscriber_count", period, reference).first()
    return (row.status, row.comparison_days, row.is_provisional, str(row.base_date), row.delta)


@pytest.mark.parametrize(
    ("pairs", "period", "expected"),
    [
        ([("2026-07-17", 120), ("2026-07-10", 100)], 7, ("ready", 7, False, "2026-07-10", 20)),
        ([("2026-07-17", 150), ("2026-07-13", 130), ("2026-07-09", 100)], 7, ("ready", 8, True, "2026-07-09", 50)),
        ([("2026-07-17", 100)], 30, ("insufficient", 0, False, "None", 0)),
        ([("2026-07-17", 120), ("2026-07-16", 100)], 7, ("insufficient", 0, False, "None", 0)),
        ([("2026-07-17", 120), ("2026-07-16", 100)], 1, ("ready", 1, False, "2026-07-16", 20)),
        ([("2026-07-17", 120), ("2026-07-15", 100)], 1, ("ready", 2, True, "2026-07-15", 20)),
        ([("2026-07-17", 150), ("2026-07-11", 100)], 7, ("ready", 6, True, "2026-07-11", 50)),
        ([("2026-07-17", 150), ("2026-07-13", 100)], 1, ("insufficient", 0, False, "None", 0)),
        ([("2026-08-01", 120), ("2026-07-01", 100)], 30, ("ready", 31, True, "2026-07-01", 20)),
        ([("2026-07-17", None), ("2026-07-10", 100)], 7, ("insufficient", 0, False, "None", 0)),
        ([("2026-07-17", 120), ("2026-07-10", None)], 7, ("insufficient", 0, False, "None", 0)),
        # Two rows at the same distance: the earlier one is the baseline.
        ([("2026-07-17", 120), ("2026-07-11", 90), ("2026-07-09", 80)], 7, ("ready", 8, True, "2026-07-09", 40)),
        # A NULL row on the exact day is passed over.
        ([("2026-07-17", 120), ("2026-07-10", None), ("2026-07-11", 100)], 7, ("ready", 6, True, "2026-07-11", 20)),
    ],
)
def test_period_comparison(spark, pairs, period, expected):
    assert compared(spark, pairs, period) == expected


def test_reference_day_hides_later_rows(spark):
    pairs = [("2026-07-20", 200), ("2026-07-17", 120), ("2026-07-10", 100)]
    assert compared(spark, pairs, 7, "2026-07-17") == ("ready", 7, False, "2026-07-10", 20)


def test_repeated_days_are_refused(spark):
    with pytest.raises(Exception, match="several snapshots on one day of key 1"):
        compared(spark, [("2026-07-17", 120), ("2026-07-10", 100), ("2026-07-10", 90)], 7)
    # A repeated day that no comparison needs changes nothing.
    pairs = [("2026-07-17", 120), ("2026-07-10", 100), ("2026-01-01", 5), ("2026-01-01", 7)]
    assert compared(spark, pairs, 7) == ("ready", 7, False, "2026-07-10", 20)


def test_only_days_of_the_windows_are_read_and_shuffled(spark, folder):
    start = dt.date(2026, 1, 1)
    rows = [(k, start + dt.timedelta(days=d), k + d) for k in range(5) for d in range(200)]
    append_by_day(spark.createDataFrame(rows, "entity_id BIGINT, date DATE, subscriber_count BIGINT"), folder + "/days")
    stored = spark.read.parquet(folder + "/days")
    frame = W.period_comparison(stored, "entity_id", "subscriber_count", 7, "2026-06-30")
    assert {r.status for r in frame.collect()} == {"ready"}
    plan = frame._jdf.queryExecution().executedPlan()
    scans = [line for line in plan.toString().split("== Initial Plan ==")[0].splitlines() if "FileScan" in line]
    assert scans and all("date" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    assert any("dynamicpruning" in s for s in scans) and "ReusedExchange" in plan.toString()
    wide = W.days_needed(spark.createDataFrame([(dt.date(2026, 6, 30),)], "d DATE"), [7])
    assert sorted(str(r.date) for r in wide.collect()) == ["2026-06-21", "2026-06-22", "2026-06-23", "2026-06-24", "2026-06-25", "2026-06-30"]


def test_newest_collection_wins_a_day(spark):
    rows = [
        (1, dt.date(2026, 7, 17), 120, dt.datetime(2026, 7, 17, 1)),
        (1, dt.date(2026, 7, 17), 130, dt.datetime(2026, 7, 17, 2)),
        (1, dt.date(2026, 7, 10), 100, dt.datetime(2026, 7, 10, 1)),
    ]
    raw = spark.createDataFrame(rows, "entity_id BIGINT, date DATE, subscriber_count BIGINT, collected_at TIMESTAMP")
    day = W.one_per_day(raw, "entity_id", ["subscriber_count"])
    row = W.period_comparison(day, "entity_id", "subscriber_count", 7).first()
    assert (row.latest_value, row.comparison_days, row.snapshot_count) == (130, 7, 3)


def test_all_periods_agree_with_single_ones(spark, rows):
    start = dt.date(2026, 1, 1)
    pairs = [(str(start + dt.timedelta(days=i * 3)), i * i % 17) for i in range(40)]
    together = W.period_comparisons(daily(spark, pairs), "entity_id", "subscriber_count", [1, 7, 30, 90])
    for period in (1, 7, 30, 90):
        single = W.period_comparison(daily(spark, pairs), "entity_id", "subscriber_count", period)
        assert rows(together.where(F.col("period") == period).drop("period")) == rows(single)


def test_ranking_lists(spark, rows):
    entities = spark.createDataFrame(
        [(1, "a"), (2, "B"), (3, "c"), (4, "d"), (5, "e")], "entity_id BIGINT, name STRING"
    ).selectExpr(
        "entity_id", "name", "'x' AS external_id", "'h' AS handle", "'hall' AS category",
        "CAST(NULL AS STRING) AS thumbnail_url", "entity_id <> 5 AS active",
    )
    days = [dt.date(2026, 7, 10), dt.date(2026, 7, 17)]
    values = {1: (100, 110), 2: (100, 110), 3: (100, 100), 4: (100, 90), 5: (1, 9)}
    snapshots = spark.createDataFrame(
        [(k, d, x) for k, v in values.items() for d, x in zip(days, v)], "entity_id BIGINT, date DATE, subscriber_count BIGINT"
    )
    ranking = growth_ranking(entities, snapshots, 7)
    assert [r.name for r in ranking_list(ranking, "rising").collect()] == ["a", "B"]
    assert rows(ranking_list(ranking, "falling"), "name", "delta", "delta_pct") == [("d", -10, -10.0)]
    # No change is on no list, inactive entities are absent.
    assert rows(ranking, "entity_id") == [(1,), (2,), (4,)]


def test_single_snapshot_is_insufficient(spark, rows):
    entities = spark.createDataFrame([(1, "a")], "entity_id BIGINT, name STRING").selectExpr(
        "entity_id", "name", "'x' AS external_id", "'h' AS handle", "'hall' AS category", "'t' AS thumbnail_url", "true AS active"
    )
    ranking = growth_ranking(entities, daily(spark, [("2026-07-27", 100)]), 7)
    assert rows(ranking, "list", "latest_count", F.col("latest_date").cast("string"), "snapshot_count") == [
        ("insufficient", 100, "2026-07-27", 1)
    ]


def test_overview_compares_the_last_eight_rows(spark):
    pairs = [(f"2026-07-{d:02d}", d * 10) for d in range(1, 12)]
    row = W.newest_vs_oldest_of_last(daily(spark, pairs), "entity_id", "subscriber_count").first()
    assert (row.latest_value, row.weekly_delta, row.weekly_delta_pct) == (110, 70, 175.0)


def test_chart_series_skips_non_positive_rows(spark, rows):
    pairs = [("2026-07-01", 100), ("2026-07-02", 0), ("2026-07-03", 90), ("2026-07-05", 130)]
    series = W.chart_series(daily(spark, pairs), "entity_id", "subscriber_count", from_start=True)
    assert rows(series, "raw_value", "value", "day_diff") == [(100, 0, 0), (130, 30, 40), (90, -10, -10)]
    facts = W.series_facts(daily(spark, pairs), "entity_id", "subscriber_count").first()
    assert (facts.delta, facts.is_public, facts.span_days) == (30, True, 5)


def test_chart_series_of_hidden_counts_keeps_all_rows(spark, rows):
    pairs = [("2026-07-01", 0), ("2026-07-02", 0)]
    series = W.chart_series(daily(spark, pairs), "entity_id", "subscriber_count", from_start=True)
    assert rows(series, "raw_value", "value", "day_diff") == [(0, 0, 0), (0, 0, 0)]
    assert W.series_facts(daily(spark, pairs), "entity_id", "subscriber_count").first().is_public is False
