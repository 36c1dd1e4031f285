"""The given tables seen as the domain tables.

Each view is stated twice: as a DataFrame for the jobs, and as SQL text (``SQL``) from which the
checks build their statements.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F


class Views:
    """Domain tables over the Parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _select(self, table: str, *columns: str) -> DataFrame:
        return self.table(table).selectExpr(*columns)

    def entities(self) -> DataFrame:
        return self._select(
            "customer",
            "c_custkey AS entity_id",
            "CASE WHEN c_nationkey < 20 THEN concat('ext', c_custkey) END AS external_id",
            "CASE WHEN c_nationkey >= 5 THEN concat('@h', c_custkey) END AS handle",
            "c_name AS name",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'media' WHEN 'AUTOMOBILE' THEN 'performer' WHEN 'HOUSEHOLD' "
            "THEN 'individual' WHEN 'MACHINERY' THEN 'manufacturer' ELSE 'hall' END AS category",
            "c_acctbal >= 0 AS active",
            "CAST(NULL AS STRING) AS thumbnail_url",
        )

    def observations(self) -> DataFrame:
        """Every event as one collected counter of its user; several per day."""
        return self._select(
            "events",
            "user_id AS entity_id",
            "to_date(from_utc_timestamp(ts, 'Asia/Tokyo')) AS date",
            "CAST(floor(value) AS BIGINT) AS subscriber_count",
            "event_id",
            "ts AS collected_at",
        )

    def entity_daily(self) -> DataFrame:
        """Running counters per user and day; days are summed before they are accumulated."""
        per_day = (
            self._select("events", "user_id AS entity_id", "to_date(from_utc_timestamp(ts, 'Asia/Tokyo')) AS date", "value")
            .groupBy("entity_id", "date")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("v"))
        )
        running = "OVER (PARTITION BY entity_id ORDER BY date)"
        return per_day.selectExpr(
            "entity_id",
            "date",
            f"sum(n) {running} AS subscriber_count",
            f"sum(v) {running} AS view_count",
            "n AS video_count",
        )

    def items(self) -> DataFrame:
        return self._select(
            "orders",
            "o_orderkey AS item_id",
            "o_custkey AS entity_id",
            "CASE o_orderpriority WHEN '1-URGENT' THEN concat('【WebCM】 機種 ', o_orderkey) WHEN '2-HIGH' THEN "
            "concat('生配信 ', o_orderkey) WHEN '3-MEDIUM' THEN concat('clip ', o_orderkey, ' #shorts') "
            "WHEN '4-NOT SPECIFIED' THEN concat('CM ', o_orderkey) ELSE concat('order ', o_orderkey) END AS title",
            "CAST(NULL AS STRING) AS thumbnail_url",
            "o_orderdate AS published_at",
            "CAST(floor(o_totalprice) AS BIGINT) AS view_count",
            "CAST(floor(o_totalprice / 100) AS BIGINT) AS like_count",
            "CAST(floor(o_totalprice / 1000) AS BIGINT) AS comment_count",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'live' WHEN '2-HIGH' THEN 'short' WHEN '3-MEDIUM' THEN 'standard' "
            "WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'promotion' END AS content_type",
            "CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'ambiguous' ELSE 'unmatched' END AS match_status",
            "CASE WHEN o_totalprice >= 20000 THEN CAST(floor(o_totalprice / 5000) AS BIGINT) END AS duration_seconds",
            "CASE WHEN o_totalprice > 450000 THEN 'Live' WHEN o_totalprice >= 30000 THEN 'none' END AS live_flag",
            "o_orderdate AS updated_at",
        )

    def catalog(self) -> DataFrame:
        return self._select(
            "part",
            "p_partkey AS catalog_id",
            "p_name AS name",
            "p_brand AS maker",
            "CASE p_type WHEN 'ECONOMY' THEN 'pachinko' WHEN 'STANDARD' THEN 'スロット' WHEN 'MEDIUM' THEN 'パチスロ' "
            "WHEN 'PROMO' THEN ' Pachinko ' WHEN 'SMALL' THEN 'slot' END AS type",
            "date_add(DATE '1995-01-01', p_size * 40) AS release_date",
            "CASE WHEN p_size > 10 THEN concat(p_name, ' ', p_type) END AS short_name",
            "CAST(NULL AS STRING) AS series",
            "array(p_type, concat(p_name, ' ', p_brand)) AS aliases",
            "CASE WHEN p_size > 25 THEN array(concat(p_brand, ' ', p_type)) END AS unique_aliases",
            "CAST(NULL AS ARRAY<STRING>) AS ambiguous_aliases",
            "array(p_brand) AS resolving_keywords",
            "CASE WHEN p_size < 5 THEN array(p_type) END AS exclude_terms",
            "CAST(NULL AS STRING) AS thumbnail_url",
            "CAST(NULL AS STRING) AS source_url",
            "CAST(NULL AS STRING) AS official_url",
        )

    def links(self) -> DataFrame:
        return self._select(
            "lineitem",
            "CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS link_id",
            "l_orderkey AS item_id",
            "l_partkey AS catalog_id",
            "CASE WHEN l_returnflag = 'A' THEN 'exact_name' WHEN l_returnflag = 'N' THEN 'alias' "
            "WHEN l_linestatus = 'F' THEN 'manual_excluded' ELSE 'manual' END AS method",
            "CASE WHEN l_returnflag = 'A' THEN 100 WHEN l_returnflag = 'N' THEN 85 WHEN l_linestatus = 'F' THEN 0 "
            "ELSE 100 END AS confidence",
            "l_shipdate AS updated_at",
        )

    def item_daily(self) -> DataFrame:
        """Item counters on the day of the line number; the newest ship date wins a day."""
        per_day = (
            self._select(
                "lineitem",
                "l_orderkey AS item_id",
                "date_add(DATE '2024-01-01', l_linenumber) AS date",
                "CAST(floor(l_extendedprice) AS BIGINT) AS view_count",
                "l_shipdate",
            )
            .groupBy("item_id", "date")
            .agg(F.max(F.struct("l_shipdate", "view_count")).alias("v"))
        )
        return per_day.selectExpr("item_id", "date", "v.view_count AS view_count")

    def votes(self) -> DataFrame:
        return self._select(
            "events",
            "event_id AS vote_id",
            "CAST(get_json_object(props, '$.k') AS BIGINT) AS target_id",
            "concat('voter-', user_id) AS voter_id",
            "CASE event_type WHEN 'purchase' THEN 'want_to_play' WHEN 'signup' THEN 'want_to_play' WHEN 'view' THEN "
            "'wait_and_see' WHEN 'error' THEN 'not_interested' ELSE 'maybe' END AS vote_type",
            "ts AS created_at",
        )

    def judgments(self) -> DataFrame:
        return self._select(
            "lineitem",
            "CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS judgment_id",
            "concat('v1:gemini:', l_orderkey, ':', l_partkey) AS judgment_key",
            "l_partkey AS catalog_id",
            "l_suppkey AS entity_id",
            "l_orderkey AS item_id",
            "CASE WHEN l_discount < 0.03 THEN 'pending' WHEN l_discount < 0.06 THEN 'rejected' ELSE 'auto_linked' END AS status",
            "CAST(round(l_tax * 1000) AS INT) AS confidence",
            "l_returnflag",
        ).where("l_returnflag = 'N'").drop("l_returnflag")

    def titles(self) -> DataFrame:
        """Whole document texts as titles."""
        return self._select("documents", "doc_id AS item_id", "text AS title")

    def phrases(self) -> DataFrame:
        """Benchmark passages as a catalog: the passage is the name, its sentences are aliases.

        A second entry per passage is named after the first sentence only, so that matches overlap.
        """
        passages = self._select(
            "benchmark",
            "item_id AS catalog_id",
            "text AS name",
            "split(text, '\\\\.')[0] AS short_name",
            "split(text, '\\\\.') AS aliases",
            "CAST(NULL AS ARRAY<STRING>) AS unique_aliases",
            "split(text, ',') AS ambiguous_aliases",
            "array(substring(text, 1, 12), substring(text, 30, 10)) AS resolving_keywords",
            "CASE WHEN contains(text, 'ó') THEN array(substring(text, 40, 30)) END AS exclude_terms",
        )
        openings = self._select("benchmark", "item_id + 1000000 AS catalog_id", "split(text, '\\\\.')[0] AS name")
        return passages.unionByName(openings, allowMissingColumns=True)


# The same views for the checks. Statements over these names get what they need prepended.
SQL = {
    "entities": """SELECT c_custkey AS entity_id, CASE WHEN c_nationkey < 20 THEN 'ext' || c_custkey END AS external_id,
        CASE WHEN c_nationkey >= 5 THEN '@h' || c_custkey END AS handle, c_name AS name,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'media' WHEN 'AUTOMOBILE' THEN 'performer' WHEN 'HOUSEHOLD' THEN 'individual'
        WHEN 'MACHINERY' THEN 'manufacturer' ELSE 'hall' END AS category, c_acctbal >= 0 AS active,
        CAST(NULL AS VARCHAR) AS thumbnail_url FROM customer""",
    "observations": """SELECT user_id AS entity_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS date,
        CAST(floor(value) AS BIGINT) AS subscriber_count, event_id, ts AS collected_at FROM events""",
    "entity_daily": """SELECT entity_id, date, CAST(sum(n) OVER (PARTITION BY entity_id ORDER BY date) AS BIGINT) AS subscriber_count,
        CAST(sum(v) OVER (PARTITION BY entity_id ORDER BY date) AS BIGINT) AS view_count, n AS video_count
        FROM (SELECT user_id AS entity_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS date, count(*) AS n,
        sum(CAST(floor(value * 100) AS BIGINT)) AS v FROM events GROUP BY ALL)""",
    "items": """SELECT o_orderkey AS item_id, o_custkey AS entity_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN '【WebCM】 機種 ' || o_orderkey WHEN '2-HIGH' THEN '生配信 ' || o_orderkey
        WHEN '3-MEDIUM' THEN 'clip ' || o_orderkey || ' #shorts' WHEN '4-NOT SPECIFIED' THEN 'CM ' || o_orderkey
        ELSE 'order ' || o_orderkey END AS title, CAST(NULL AS VARCHAR) AS thumbnail_url, o_orderdate AS published_at,
        CAST(floor(o_totalprice) AS BIGINT) AS view_count, CAST(floor(o_totalprice / 100) AS BIGINT) AS like_count,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS comment_count,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'live' WHEN '2-HIGH' THEN 'short' WHEN '3-MEDIUM' THEN 'standard'
        WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'promotion' END AS content_type,
        CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'ambiguous' ELSE 'unmatched' END AS match_status,
        CASE WHEN o_totalprice >= 20000 THEN CAST(floor(o_totalprice / 5000) AS BIGINT) END AS duration_seconds,
        CASE WHEN o_totalprice > 450000 THEN 'Live' WHEN o_totalprice >= 30000 THEN 'none' END AS live_flag,
        o_orderdate AS updated_at FROM orders""",
    "catalog": """SELECT p_partkey AS catalog_id, p_name AS name, p_brand AS maker,
        CASE p_type WHEN 'ECONOMY' THEN 'pachinko' WHEN 'STANDARD' THEN 'スロット' WHEN 'MEDIUM' THEN 'パチスロ'
        WHEN 'PROMO' THEN ' Pachinko ' WHEN 'SMALL' THEN 'slot' END AS type,
        DATE '1995-01-01' + CAST(p_size * 40 AS INTEGER) AS release_date,
        CASE WHEN p_size > 10 THEN p_name || ' ' || p_type END AS short_name, CAST(NULL AS VARCHAR) AS series,
        [p_type, p_name || ' ' || p_brand] AS aliases, CASE WHEN p_size > 25 THEN [p_brand || ' ' || p_type] END AS unique_aliases,
        [p_brand] AS resolving_keywords, CASE WHEN p_size < 5 THEN [p_type] END AS exclude_terms FROM part""",
    "kinds": """SELECT *, CASE WHEN lower(trim(type)) IN ('pachinko', 'パチンコ', 'ぱちんこ') THEN 'pachinko'
        WHEN lower(trim(type)) IN ('slot', 'pachislot', 'pachislo', 'パチスロ', 'ぱちすろ', 'スロット', 'パチスロット')
        THEN 'slot' END AS kind FROM catalog""",
    "links": """SELECT CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS link_id, l_orderkey AS item_id,
        l_partkey AS catalog_id, CASE WHEN l_returnflag = 'A' THEN 'exact_name' WHEN l_returnflag = 'N' THEN 'alias'
        WHEN l_linestatus = 'F' THEN 'manual_excluded' ELSE 'manual' END AS method,
        CASE WHEN l_returnflag = 'A' THEN 100 WHEN l_returnflag = 'N' THEN 85 WHEN l_linestatus = 'F' THEN 0 ELSE 100 END
        AS confidence, l_shipdate AS updated_at FROM lineitem""",
    "item_daily": """SELECT item_id, date, view_count FROM (SELECT l_orderkey AS item_id,
        DATE '2024-01-01' + CAST(l_linenumber AS INTEGER) AS date, CAST(floor(l_extendedprice) AS BIGINT) AS view_count,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, floor(l_extendedprice) DESC) AS rn
        FROM lineitem) WHERE rn = 1""",
    "votes": """SELECT event_id AS vote_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target_id,
        'voter-' || user_id AS voter_id, CASE event_type WHEN 'purchase' THEN 'want_to_play' WHEN 'signup' THEN 'want_to_play'
        WHEN 'view' THEN 'wait_and_see' WHEN 'error' THEN 'not_interested' ELSE 'maybe' END AS vote_type, ts AS created_at
        FROM events""",
    "judgments": """SELECT CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS judgment_id,
        'v1:gemini:' || l_orderkey || ':' || l_partkey AS judgment_key, l_partkey AS catalog_id, l_suppkey AS entity_id,
        l_orderkey AS item_id, CASE WHEN l_discount < 0.03 THEN 'pending' WHEN l_discount < 0.06 THEN 'rejected'
        ELSE 'auto_linked' END AS status, CAST(round(l_tax * 1000) AS INTEGER) AS confidence FROM lineitem
        WHERE l_returnflag = 'N'""",
    "titles": """SELECT doc_id AS item_id, text AS title, regexp_replace(lower(text),
        '[\\s\\x{3000}・･\\-_()\\[\\]【】「」『』]', '', 'g') AS title_text FROM documents""",
    "phrases": """SELECT item_id AS catalog_id, text AS name, string_split(text, '.')[1] AS short_name,
        string_split(text, '.') AS aliases, string_split(text, ',') AS ambiguous_aliases,
        [substr(text, 1, 12), substr(text, 30, 10)] AS resolving_keywords,
        CASE WHEN contains(text, 'ó') THEN [substr(text, 40, 30)] END AS exclude_terms FROM benchmark
        UNION ALL SELECT item_id + 1000000, string_split(text, '.')[1], NULL, [], [], [], NULL FROM benchmark""",
    # Confirmed (item, entry) pairs, all and rankable ones.
    "confirmed": """SELECT DISTINCT l.item_id, l.catalog_id, i.entity_id, i.view_count, i.content_type, i.published_at,
        i.updated_at FROM links l JOIN items i USING (item_id)
        WHERE i.match_status = 'matched' AND l.method <> 'manual_excluded'""",
    "rankable": "SELECT * FROM confirmed WHERE content_type IN ('standard', 'short', 'live')",
    "mentions": """SELECT l.item_id, l.catalog_id, i.entity_id, i.title, i.view_count, i.like_count, i.comment_count,
        i.published_at FROM (SELECT DISTINCT item_id, catalog_id FROM links WHERE method <> 'manual_excluded') l
        JOIN items i USING (item_id)""",
    # Period comparison of items at 1 and 7 days.
    "item_trend_1": "@compare item_daily item_id view_count 1 1 3",
    "item_trend_7": "@compare item_daily item_id view_count 7 5 9",
    # Entries of equal name and maker: the smallest id is canonical.
    "merge_groups": """SELECT canonical_id, catalog_id AS duplicate_id FROM (SELECT catalog_id,
        min(catalog_id) OVER (PARTITION BY name, maker) AS canonical_id FROM catalog) WHERE canonical_id <> catalog_id""",
}


def fixed_sql(x: str, digits: int) -> str:
    """SQL for rounding the exact binary value, exact ties away from zero."""
    scale = 2 ** (digits + 1)
    return (
        f"(CASE WHEN abs({x}) * {scale} = floor(abs({x}) * {scale}) THEN round({x}, {digits}) "
        f"ELSE CAST(printf('%.{digits}f', {x}) AS DOUBLE) END + 0.0)"
    )


def percent_sql(delta: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {fixed_sql(f'(CAST({delta} AS DOUBLE) / {base} * 100)', 2)} ELSE 0.0 END"


def compare_sql(source: str, key: str, value: str, period: int, low: int, high: int) -> str:
    """SQL for the period comparison of one snapshot view."""
    return f"""SELECT {key}, latest_date, latest_value, snapshot_count, is_ready,
        CASE WHEN is_ready THEN base_date END AS base_date, CASE WHEN is_ready THEN base_value END AS base_value,
        CASE WHEN is_ready THEN n_days ELSE 0 END AS comparison_days,
        CASE WHEN is_ready THEN 'ready' ELSE 'insufficient' END AS status,
        is_ready AND n_days <> {period} AS is_provisional,
        CASE WHEN is_ready THEN latest_value - base_value ELSE 0 END AS delta,
        CASE WHEN is_ready THEN {percent_sql('(latest_value - base_value)', 'base_value')} ELSE 0.0 END AS delta_pct
        FROM (SELECT *, CAST(latest_date - base_date AS BIGINT) AS n_days,
            coalesce(latest_value IS NOT NULL AND latest_date - base_date BETWEEN {low} AND {high}, false) AS is_ready
            FROM (SELECT a.{key}, a.date AS latest_date, a.{value} AS latest_value, a.n AS snapshot_count,
                b.date AS base_date, b.{value} AS base_value
                FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n,
                    row_number() OVER (PARTITION BY {key} ORDER BY date DESC) AS rn FROM {source}) a
                LEFT JOIN {source} b ON b.{key} = a.{key} AND b.date < a.date AND b.{value} IS NOT NULL
                WHERE a.rn = 1
                QUALIFY row_number() OVER (PARTITION BY a.{key}
                    ORDER BY abs((a.date - {period}) - b.date) NULLS LAST, b.date) = 1))"""


def _definition(name: str) -> str:
    text = SQL[name]
    if text.startswith("@compare"):
        _, source, key, value, *numbers = text.split()
        return compare_sql(source, key, value, *map(int, numbers))
    return text


def with_views(statement: str) -> str:
    """Prepend the views that a statement uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in needed:
                visit(_definition(name))
                needed.append(name)

    visit(statement)
    if not needed:
        return statement
    views = ",\n".join(f"{name} AS ({_definition(name)})" for name in needed)
    body = statement.lstrip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE '):]}"
    if body.startswith("WITH "):
        return f"WITH {views},\n{body[len('WITH '):]}"
    return f"WITH {views}\n{body}"
