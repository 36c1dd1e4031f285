"""Stages that hold several sorts or maps of their rows keep all shuffle partitions, however small their bytes are."""

import pytest
from pyspark.sql import functions as F

from risemeter.operators.snapshots import period_comparison
from risemeter.plans import catalog as C
from risemeter.plans.review import apply_overrides
from risemeter.schemas import key_problems


def parts(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.fixture
def large(spark):
    """Joins as of large tables."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in settings:
        spark.conf.set(name, "-1")
    yield
    for name in settings:
        spark.conf.unset(name)


def test_period_comparisons_are_not_merged(spark, large):
    daily = spark.range(60).selectExpr("id % 20 AS item_id", "date_add(DATE '2024-01-01', cast(id div 20 AS INT) * 7) AS date", "id * id AS view_count")
    compared = period_comparison(daily, "item_id", "view_count", 7)
    assert compared.rdd.getNumPartitions() == parts(spark)
    rows = {r.item_id: (r.latest_value, r.delta) for r in compared.collect()}
    assert rows == {k: ((k + 40) ** 2, (k + 40) ** 2 - (k + 20) ** 2) for k in range(20)}


def test_key_problems_are_not_merged(spark, large):
    """Also over rows that are grouped by the same keys already."""
    daily = spark.range(90).selectExpr("id % 30 AS item_id", "date_add(DATE '2024-01-01', cast(id % 3 AS INT)) AS date", "id AS view_count")
    grouped = daily.groupBy("item_id", "date").agg(F.max("view_count").alias("view_count"))
    assert key_problems({"item_snapshots": grouped}).rdd.getNumPartitions() == parts(spark)
    assert key_problems({"item_snapshots": grouped}).count() == 0
    twice = key_problems({"item_snapshots": grouped.unionByName(grouped.where("item_id = 4"))}).collect()
    assert [(r.table, r.key, r.occurrences) for r in twice] == [("item_snapshots", "4|2024-01-02", 2)]


def test_overrides_are_not_merged(spark, large):
    items = spark.range(8).selectExpr("id AS item_id", "'matched' AS match_status")
    links = spark.range(8).selectExpr("id AS item_id", "1L AS catalog_id", "'alias' AS method", "85 AS confidence")
    catalog = spark.range(3).selectExpr("id AS catalog_id")
    overrides = spark.createDataFrame(
        [(1, 1, "exclude", 1), (2, 2, "link", 1), (3, 1, "link", 1), (3, 1, "exclude", 2), (4, 9, "link", 1)],
        "item_id BIGINT, catalog_id BIGINT, kind STRING, position BIGINT",
    )
    done = apply_overrides(items, links, catalog, overrides)
    for result in (done.links, done.items):
        assert "REPARTITION_BY_NUM" in result._jdf.queryExecution().executedPlan().toString()
    states = {r.item_id: r.match_status for r in done.items.collect()}
    assert states == {0: "matched", 1: "manual_excluded", 2: "manual", 3: "manual_excluded", **{k: "matched" for k in range(4, 8)}}
    assert done.links.count() == 9


def test_items_of_a_detail_view_are_found_once(spark, monkeypatch):
    names, written = [], C.written
    monkeypatch.setattr(C, "written", lambda rows, name: names.append((name, rows.count())) or written(rows, name))
    catalog = spark.sql("SELECT 1L AS catalog_id, 'a' AS name, DATE '2024-01-01' AS release_date")
    items = spark.range(6).selectExpr(
        "id AS item_id", "7L AS entity_id", "id * 10 AS view_count", "TIMESTAMP '2024-01-03' AS published_at",
        "IF(id < 4, 'standard', 'live') AS content_type", "IF(id = 0, 'unmatched', 'matched') AS match_status",
    )
    links = spark.range(6).selectExpr("id AS item_id", "1L AS catalog_id", "'alias' AS method")
    entities = spark.sql("SELECT 7L AS entity_id, 'e' AS name")
    daily = spark.range(12).selectExpr("id % 6 AS item_id", "date_add(DATE '2024-01-01', cast(id div 6 AS INT) * 7) AS date", "id AS view_count")
    rows = C.catalog_detail(catalog, links, items, entities, daily, 1, "standard", "newest").collect()
    assert names == [("detail-items", 3)]
    assert {(r.item_id, r.delta, r.release_bucket, len(r.tags)) for r in rows} == {(k, 6, "first_7_days", 1) for k in (1, 2, 3)}
