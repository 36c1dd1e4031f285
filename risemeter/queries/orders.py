"""Queries for orders, top lists and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.operators import predicates as P, ranking as T
from risemeter.operators.snapshots import period_comparison
from risemeter.plans.catalog import catalog_buzz
from risemeter.plans.digest import digest_list
from risemeter.plans.growth import entity_items, growth_ranking, ranking_list
from risemeter.plans.items import item_trends, trending_ranked
from risemeter.queries.registry import query
from risemeter.views import Views, compare_sql

GROWTH_SQL = f"""(SELECT e.entity_id, e.name, g.delta, g.delta_pct, g.latest_value, g.is_ready FROM entities e JOIN
    ({compare_sql('entity_daily', 'entity_id', 'view_count', 7, 5, 9)}) g USING (entity_id) WHERE active)"""


def _growth(v: Views) -> DataFrame:
    daily = v.entity_daily().select("entity_id", "date", F.col("view_count").alias("subscriber_count"))
    return growth_ranking(v.entities(), daily, 7)


@query(
    "t1_rising",
    f"SELECT entity_id, delta, row_number() OVER (ORDER BY delta DESC, name, entity_id) AS place FROM {GROWTH_SQL} WHERE delta > 0",
)
def _(v: Views) -> DataFrame:
    return _placed(ranking_list(_growth(v), "rising"), [F.desc("delta"), F.asc("name"), F.asc("entity_id")], "entity_id", "delta")


def _placed(ranked: DataFrame, order: list, *columns: str) -> DataFrame:
    """All rows of an ordered list with their place."""
    return T.with_positions(ranked, order, "place").select(*columns, F.col("place").cast("long").alias("place"))


@query(
    "t2_by_growth_rate",
    f"""SELECT entity_id, delta_pct, row_number() OVER (ORDER BY delta_pct DESC, delta DESC, name, entity_id) AS place FROM {GROWTH_SQL}
    WHERE delta > 0""",
)
def _(v: Views) -> DataFrame:
    ranked = T.by_growth_rate(ranking_list(_growth(v), "rising"), upwards=True)
    order = [F.desc("delta_pct"), F.desc("delta"), F.asc("name"), F.asc("entity_id")]
    return _placed(ranked, order, "entity_id", "delta_pct")


TRENDING_SQL = """(SELECT i.item_id, i.view_count, i.content_type, t.delta, t.delta_pct, e.name AS entity_name FROM items i JOIN entities e USING (entity_id)
    JOIN item_trend_1 t ON t.item_id = i.item_id WHERE t.is_ready AND t.delta > 0 AND i.content_type IN ('standard', 'short'))"""


@query(
    "t3_trending_order",
    f"""SELECT item_id, delta, row_number() OVER (ORDER BY delta DESC, view_count DESC, CAST(item_id AS VARCHAR)) AS place
    FROM {TRENDING_SQL}""",
)
def _(v: Views) -> DataFrame:
    ranked = trending_ranked(v.items(), v.entities(), v.item_daily(), "previous", "standard,short").orderBy(*T.trending_order())
    return _placed(ranked, T.trending_order(), "item_id", "delta")


BUZZ_SQL = """(SELECT c.catalog_id, c.name, c.maker, CAST(c.release_date AS VARCHAR) AS release_date, c.kind AS type,
    CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views, count(item_id) AS item_count,
    CAST(coalesce(sum(CASE WHEN is_ready THEN greatest(0, delta) ELSE 0 END), 0) AS BIGINT) AS recent_views,
    count(*) FILTER (is_ready) AS recent_item_count, count(DISTINCT entity_id) AS entity_count
    FROM kinds c LEFT JOIN (SELECT catalog_id, item_id, entity_id, view_count FROM rankable) USING (catalog_id)
    LEFT JOIN item_trend_7 USING (item_id) GROUP BY ALL)"""


def _buzz(v: Views) -> DataFrame:
    return catalog_buzz(v.catalog(), v.links(), v.items(), v.item_daily())


@query(
    "t4_momentum_order",
    f"""SELECT catalog_id, recent_views, row_number() OVER (ORDER BY recent_views DESC, total_views DESC, catalog_id) AS place
    FROM {BUZZ_SQL}""",
)
def _(v: Views) -> DataFrame:
    return _placed(_buzz(v), T.momentum_order(), "catalog_id", "recent_views")


@query(
    "t5_item_order_views",
    """SELECT item_id, row_number() OVER (ORDER BY view_count DESC, published_at DESC, CAST(item_id AS VARCHAR)) AS place FROM items""",
)
def _(v: Views) -> DataFrame:
    return _placed(v.items().orderBy(*T.item_order("views")), T.item_order("views"), "item_id")


@query(
    "t5_item_order_newest",
    """SELECT item_id, row_number() OVER (ORDER BY published_at DESC, view_count DESC, CAST(item_id AS VARCHAR)) AS place FROM items""",
)
def _(v: Views) -> DataFrame:
    return _placed(v.items().orderBy(*T.item_order("newest")), T.item_order("newest"), "item_id")


@query(
    "t5_item_order_rising",
    f"""SELECT item_id, row_number() OVER (ORDER BY delta DESC, view_count DESC, CAST(item_id AS VARCHAR)) AS place FROM {TRENDING_SQL}""",
)
def _(v: Views) -> DataFrame:
    gained = trending_ranked(v.items(), v.entities(), v.item_daily(), "previous", "standard,short")
    return _placed(gained, T.item_order("rising"), "item_id")


@query("t6_top_five", f"SELECT catalog_id, name, recent_views FROM {BUZZ_SQL} ORDER BY recent_views DESC, total_views DESC, catalog_id LIMIT 5")
def _(v: Views) -> DataFrame:
    return T.top(_buzz(v), T.momentum_order()).select("catalog_id", "name", "recent_views")


@query(
    "t7_first_page",
    f"""SELECT item_id, delta, view_count, (SELECT count(*) > 25 FROM {TRENDING_SQL}) AS has_next FROM {TRENDING_SQL}
    ORDER BY delta DESC, view_count DESC, CAST(item_id AS VARCHAR) LIMIT 25""",
)
def _(v: Views) -> DataFrame:
    ranked = trending_ranked(v.items(), v.entities(), v.item_daily(), "previous", "standard,short")
    return T.page_after(ranked, T.clamp_limit("25", 50, 100)).select("item_id", "delta", "view_count", "has_next")


@query(
    "t7_page_after_key",
    f"""WITH rest AS (SELECT * FROM {TRENDING_SQL} WHERE delta < 40000 OR (delta = 40000 AND view_count < 100000))
    SELECT item_id, delta, view_count, (SELECT count(*) > 25 FROM rest) AS has_next FROM rest
    ORDER BY delta DESC, view_count DESC, CAST(item_id AS VARCHAR) LIMIT 25""",
)
def _(v: Views) -> DataFrame:
    ranked = trending_ranked(v.items(), v.entities(), v.item_daily(), "previous", "standard,short")
    return T.page_after(ranked, 25, (40000, 100000, "zzz")).select("item_id", "delta", "view_count", "has_next")


@query(
    "t8_limit_and_offset",
    """SELECT item_id, view_count FROM items ORDER BY view_count DESC, item_id LIMIT 100 OFFSET 40""",
)
def _(v: Views) -> DataFrame:
    limit, offset = T.clamp_limit("1000", 50, 100), T.offset_from("40")
    return v.items().select("item_id", "view_count").orderBy(F.desc("view_count"), "item_id").offset(offset).limit(limit)


@query("t9_visible_slice", f"SELECT catalog_id FROM {BUZZ_SQL} WHERE item_count > 0 ORDER BY recent_views DESC, total_views DESC, catalog_id LIMIT 40")
def _(v: Views) -> DataFrame:
    return T.visible_slice(P.ranked_only(_buzz(v)), T.momentum_order(), 20).select("catalog_id")


@query(
    "t10_entity_items",
    """SELECT item_id, view_count FROM items WHERE entity_id = 12 ORDER BY published_at DESC, view_count DESC, item_id LIMIT 100""",
)
def _(v: Views) -> DataFrame:
    return entity_items(v.items(), 12, "views").select("item_id", "view_count")


@query(
    "t12_by_audience",
    f"""SELECT entity_id, latest_value, row_number() OVER (ORDER BY latest_value DESC, entity_id) AS place FROM
    ({compare_sql('entity_daily', 'entity_id', 'subscriber_count', 7, 5, 9)})""",
)
def _(v: Views) -> DataFrame:
    compared = period_comparison(v.entity_daily(), "entity_id", "subscriber_count", 7)
    return _placed(compared.orderBy(*T.by_audience()), T.by_audience(), "entity_id", "latest_value")


@query(
    "t13_digest_list",
    """SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_of, 'week ' || count(*) AS title FROM events
    GROUP BY date_trunc('week', ts)""",
)
def _(v: Views) -> DataFrame:
    weeks = v.table("events").groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week_of")).agg(
        F.concat(F.lit("week "), F.count(F.lit(1)).cast("string")).alias("title")
    )
    return digest_list(weeks)


@query("t1_falling", "SELECT item_id, delta FROM item_trend_7 WHERE delta < 0")
def _(v: Views) -> DataFrame:
    named = item_trends(v.item_daily(), 7).withColumn("name", F.lit("item"))
    return T.falling(named, "item_id").select("item_id", "delta")

