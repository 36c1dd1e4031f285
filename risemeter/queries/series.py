"""Queries for snapshot series and rules over sorted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.operators import links as L, snapshots as W
from risemeter.operators.ranking import momentum_order, with_positions
from risemeter.plans.catalog import catalog_buzz
from risemeter.queries.registry import query, text, whole
from risemeter.queries.tables import HITS_SQL, hit_rows
from risemeter.plans.discovery import sample_items
from risemeter.session import fresh_folder
from risemeter.sources.sinks import append_by_day
from risemeter.views import Views, compare_sql, percent_sql


@query(
    "w1_one_per_day",
    """SELECT entity_id, CAST(date AS VARCHAR) AS date, arg_max(subscriber_count, row(collected_at, subscriber_count)) AS subscriber_count,
    count(*) AS raw_rows FROM observations GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    rows = W.one_per_day(v.observations(), "entity_id", ["subscriber_count"])
    return rows.select("entity_id", *text("date"), "subscriber_count", "raw_rows")


@query(
    "w2_latest_as_of",
    """SELECT entity_id, CAST(max(date) AS VARCHAR) AS date, arg_max(subscriber_count, date) AS subscriber_count FROM entity_daily
    WHERE date <= DATE '2024-01-20' GROUP BY entity_id""",
)
def _(v: Views) -> DataFrame:
    rows = W.latest_as_of(v.entity_daily(), "entity_id", ["subscriber_count"], "2024-01-20")
    return rows.select("entity_id", *text("date"), "subscriber_count")


_COLUMNS = """entity_id, CAST(latest_date AS VARCHAR) AS latest_date, latest_value, snapshot_count, CAST(base_date AS VARCHAR) AS base_date,
    base_value, comparison_days, status, is_provisional, delta, delta_pct"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "entity_id", *text("latest_date"), "latest_value", "snapshot_count", *text("base_date"), "base_value",
        *whole("comparison_days"), "status", "is_provisional", "delta", "delta_pct",
    )


for _period, (_low, _high) in W.PERIOD_WINDOWS.items():

    @query(
        f"w3_period_comparison_{_period}d",
        f"SELECT {_COLUMNS} FROM ({compare_sql('entity_daily', 'entity_id', 'subscriber_count', _period, _low, _high)})",
    )
    def _(v: Views, period: int = _period) -> DataFrame:
        return _shown(W.period_comparison(v.entity_daily(), "entity_id", "subscriber_count", period))


@query(
    "w3_all_periods",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS BIGINT) AS period, entity_id, status, delta FROM "
        f"({compare_sql('entity_daily', 'entity_id', 'view_count', p, low, high)})"
        for p, (low, high) in W.PERIOD_WINDOWS.items()
    ),
)
def _(v: Views) -> DataFrame:
    rows = W.period_comparisons(v.entity_daily(), "entity_id", "view_count", list(W.PERIOD_WINDOWS))
    return rows.select(*whole("period"), "entity_id", "status", "delta")


@query(
    "w3_period_comparison_as_of",
    f"""WITH early AS (SELECT * FROM entity_daily WHERE date <= DATE '2024-01-18')
    SELECT {_COLUMNS} FROM ({compare_sql('early', 'entity_id', 'subscriber_count', 7, 5, 9)})""",
)
def _(v: Views) -> DataFrame:
    return _shown(W.period_comparison(v.entity_daily(), "entity_id", "subscriber_count", 7, "2024-01-18"))


# Order dates span years, so that all windows are filled, and values rise and fall.
ORDER_DAYS = """order_days AS (SELECT o_custkey % 300 AS entity_id, CAST(o_orderdate AS DATE) AS date,
    CAST(floor(max(o_totalprice)) AS BIGINT) AS subscriber_count FROM orders GROUP BY ALL)"""


def _order_days(v: Views) -> DataFrame:
    rows = v.table("orders").selectExpr("o_custkey % 300 AS entity_id", "CAST(o_orderdate AS DATE) AS date", "o_totalprice")
    return rows.groupBy("entity_id", "date").agg(F.floor(F.max("o_totalprice")).cast("long").alias("subscriber_count"))


@query(
    "w3_order_days_all_periods",
    f"WITH {ORDER_DAYS} "
    + " UNION ALL ".join(
        f"SELECT CAST({p} AS BIGINT) AS period, entity_id, status, delta, comparison_days FROM "
        f"({compare_sql('order_days', 'entity_id', 'subscriber_count', p, low, high)})"
        for p, (low, high) in W.PERIOD_WINDOWS.items()
    ),
)
def _(v: Views) -> DataFrame:
    rows = W.period_comparisons(_order_days(v), "entity_id", "subscriber_count", list(W.PERIOD_WINDOWS))
    return rows.select(*whole("period"), "entity_id", "status", "delta", *whole("comparison_days"))


@query(
    "snk1_growth_of_appended_days",
    f"""WITH early AS (SELECT * FROM entity_daily WHERE date <= DATE '2024-01-18')
    SELECT {_COLUMNS} FROM ({compare_sql('early', 'entity_id', 'subscriber_count', 7, 5, 9)})""",
)
def _(v: Views) -> DataFrame:
    """Two appends to a table by day, then the comparison as of a day; later folders are not read."""
    rows, folder = v.entity_daily(), fresh_folder(v.spark, "by-day")
    append_by_day(rows.where("date < DATE '2024-01-12'"), folder)
    append_by_day(rows.where("date >= DATE '2024-01-12'"), folder)
    stored = v.spark.read.schema(rows.schema).parquet(folder)
    return _shown(W.period_comparison(stored, "entity_id", "subscriber_count", 7, "2024-01-18"))


OVERVIEW_SQL = f"""SELECT entity_id, latest_date, latest_value, CASE WHEN n > 1 THEN latest_value - oldest_value ELSE 0 END
    AS weekly_delta, {percent_sql('(CASE WHEN n > 1 THEN latest_value - oldest_value ELSE 0 END)', 'oldest_value')} AS weekly_delta_pct
    FROM (SELECT entity_id, CAST(max(date) AS VARCHAR) AS latest_date, arg_max(subscriber_count, date) AS latest_value,
    arg_min(subscriber_count, date) AS oldest_value, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
    ORDER BY date DESC) AS rn FROM entity_daily) WHERE rn <= 8 GROUP BY entity_id)"""


@query("w4_newest_vs_oldest_of_last", OVERVIEW_SQL)
def _(v: Views) -> DataFrame:
    rows = W.newest_vs_oldest_of_last(v.entity_daily(), "entity_id", "subscriber_count")
    return rows.select("entity_id", *text("latest_date"), "latest_value", "weekly_delta", "weekly_delta_pct")


@query(
    "w5_latest_vs_first",
    """SELECT entity_id, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS latest_date,
    arg_min(subscriber_count, date) AS first_value, arg_max(subscriber_count, date) AS latest_value,
    arg_max(subscriber_count, date) - arg_min(subscriber_count, date) AS delta FROM entity_daily GROUP BY entity_id""",
)
def _(v: Views) -> DataFrame:
    rows = W.latest_vs_first(v.entity_daily(), "entity_id", "subscriber_count")
    return rows.select("entity_id", *text("first_date", "latest_date"), "first_value", "latest_value", "delta")


# Counters with zeros, so that the positive-only rule has work.
_DAY_ROWS = """(SELECT entity_id, date, subscriber_count, view_count FROM (SELECT entity_id, date, arg_max(subscriber_count,
    row(collected_at, subscriber_count)) AS subscriber_count, count(*) AS view_count FROM observations GROUP BY ALL))"""
_PLOTTED = f"""(SELECT * FROM (SELECT *, bool_or(subscriber_count > 0) OVER (PARTITION BY entity_id) AS any_positive FROM {_DAY_ROWS})
    WHERE subscriber_count > 0 OR NOT any_positive)"""


def _days(v: Views) -> DataFrame:
    rows = W.one_per_day(v.observations(), "entity_id", ["subscriber_count"])
    return rows.withColumnRenamed("raw_rows", "view_count")


@query(
    "w6_chart_series",
    f"""SELECT entity_id, CAST(date AS VARCHAR) AS date, subscriber_count AS raw_value, subscriber_count - first_value(subscriber_count)
    OVER w AS value, coalesce(subscriber_count - lag(subscriber_count) OVER w, 0) AS day_diff FROM {_PLOTTED}
    WINDOW w AS (PARTITION BY entity_id ORDER BY date)""",
)
def _(v: Views) -> DataFrame:
    rows = W.chart_series(_days(v), "entity_id", "subscriber_count", from_start=True)
    return rows.select("entity_id", *text("date"), "raw_value", "value", "day_diff")


@query(
    "w7_series_facts",
    f"""SELECT entity_id, last AS latest_count, first AS start_count, last > 0 AND first > 0 AS is_public,
    CASE WHEN last > 0 AND first > 0 THEN last - first ELSE 0 END AS delta,
    CASE WHEN last > 0 AND first > 0 THEN CAST(last - first AS DOUBLE) / first * 100 ELSE 0.0 END AS delta_pct, span_days
    FROM (SELECT entity_id, arg_max(subscriber_count, date) AS last, arg_min(subscriber_count, date) AS first,
    CAST(max(date) - min(date) + 1 AS BIGINT) AS span_days FROM {_PLOTTED} GROUP BY entity_id)""",
)
def _(v: Views) -> DataFrame:
    return W.series_facts(_days(v), "entity_id", "subscriber_count")


@query(
    "w8_newest_samples",
    f"""SELECT external_id, item_id, position FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY published_at DESC,
    item_id) AS position FROM (SELECT DISTINCT external_id, item_id, published_at FROM ({HITS_SQL}))) WHERE position <= 5""",
)
def _(v: Views) -> DataFrame:
    return sample_items(hit_rows(v)).select("external_id", "item_id", *whole("position"))


@query(
    "w11_positions",
    """SELECT catalog_id, row_number() OVER (ORDER BY recent_views DESC, total_views DESC, catalog_id) AS position FROM (
    SELECT catalog_id, CAST(coalesce(sum(CASE WHEN is_ready THEN greatest(0, delta) ELSE 0 END), 0) AS BIGINT) AS recent_views,
    CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views FROM catalog LEFT JOIN (SELECT catalog_id, item_id, view_count
    FROM rankable) USING (catalog_id) LEFT JOIN item_trend_7 USING (item_id) GROUP BY catalog_id)""",
)
def _(v: Views) -> DataFrame:
    buzz = catalog_buzz(v.catalog(), v.links(), v.items(), v.item_daily())
    return with_positions(buzz, momentum_order()).select("catalog_id", *whole("position"))


@query(
    "w12_best_term_per_pair",
    """SELECT item_id, catalog_id, arg_min(term, row(-length(term), pos)) AS term FROM (SELECT item_id, catalog_id, unnest(aliases) AS term,
    generate_subscripts(aliases, 1) AS pos FROM links JOIN catalog USING (catalog_id)) GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    entries = v.catalog().select("catalog_id", F.posexplode("aliases").alias("pos", "term"))
    rows = v.links().select("item_id", "catalog_id").join(entries, "catalog_id")
    order = F.struct(F.negative(F.length("term")).alias("a"), F.col("pos").alias("b"))
    return L.first_by(rows, ["item_id", "catalog_id"], order).select("item_id", "catalog_id", "term")
