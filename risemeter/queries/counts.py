"""Queries for aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.misc import CATALOG_VOTE_TYPES
from risemeter.functions.numbers import mean_per_item
from risemeter.operators import links as L, tallies as A
from risemeter.plans import merge as M
from risemeter.plans.items import item_trends
from risemeter.plans.votes import accepted_votes, vote_audit, vote_counts, vote_upsert
from risemeter.queries.joins import merge_groups
from risemeter.queries.registry import query, text
from risemeter.queries.tables import entity_stat_rows
from risemeter.sources import sinks
from risemeter.views import Views

_TYPES = ["standard", "short", "live", "promotion", "unknown"]


def _filters(column: str, values: list[str]) -> str:
    return ", ".join(f"count(*) FILTER ({column} = '{v}') AS {v}" for v in values)


@query("a1_content_type_counts", f"SELECT {_filters('content_type', _TYPES)} FROM items")
def _(v: Views) -> DataFrame:
    return A.content_type_counts(v.items())


@query(
    "a2_content_types_once",
    f"SELECT catalog_id, {_filters('content_type', _TYPES)} FROM confirmed GROUP BY catalog_id",
)
def _(v: Views) -> DataFrame:
    rows = L.link_items(v.links(), v.items().select("item_id", "content_type", "match_status"))
    return A.content_type_counts_once(rows.where("match_status = 'matched' AND method <> 'manual_excluded'"), ["catalog_id"])


SUMMARY_SQL = """SELECT count(*) AS item_count, count(*) FILTER (content_type IN ('standard', 'short', 'live')) AS ranking_item_count,
    CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views,
    count(*) FILTER (published_at >= TIMESTAMP '2000-01-01' - INTERVAL 7 DAY) AS recent_item_count,
    CAST(coalesce(sum(CASE WHEN is_ready THEN greatest(0, delta) ELSE 0 END), 0) AS BIGINT) AS recent_views,
    CAST(max(updated_at) AS VARCHAR) AS last_updated_at, CAST(min(published_at) AS VARCHAR) AS period_start,
    CAST(max(published_at) AS VARCHAR) AS period_end"""


@query("a4_item_summary", f"{SUMMARY_SQL} FROM items LEFT JOIN item_trend_7 USING (item_id)")
def _(v: Views) -> DataFrame:
    now = F.lit("2000-01-01 00:00:00").cast("timestamp")
    rows = A.catalog_summary(v.items(), item_trends(v.item_daily(), 7), now)
    dated = ["last_updated_at", "period_start", "period_end"]
    return rows.select(*[c for c in rows.columns if c not in dated], *text(*dated))


_TALLY = f"SELECT target_id, {_filters('vote_type', CATALOG_VOTE_TYPES)} FROM votes GROUP BY target_id"
_SHARES = ", ".join(
    f"CASE WHEN total > 0 THEN CAST(floor(CAST({k} AS DOUBLE) / total * 100 + 0.5) AS BIGINT) ELSE 0 END AS {k}_share"
    for k in CATALOG_VOTE_TYPES
)


@query("a5_vote_tally", f"SELECT *, {_SHARES} FROM (SELECT *, {' + '.join(CATALOG_VOTE_TYPES)} AS total FROM ({_TALLY}))")
def _(v: Views) -> DataFrame:
    return vote_counts(v.votes())


@query(
    "a6_buzz_totals",
    """SELECT catalog_id, name, maker, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views, count(item_id) AS item_count
    FROM catalog c LEFT JOIN (SELECT catalog_id, item_id, view_count FROM mentions) m USING (catalog_id) GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return A.buzz_totals(v.catalog(), sinks.rebuilt_mentions(v.links(), v.items()))


@query(
    "a7_duplicate_votes",
    """SELECT target_id, voter_id, vote_id, duplicate_count, kept_id FROM votes JOIN (SELECT target_id, voter_id,
    count(*) AS duplicate_count, max(vote_id) AS kept_id FROM votes GROUP BY ALL HAVING count(*) > 1) USING (target_id, voter_id)""",
)
def _(v: Views) -> DataFrame:
    return vote_audit(v.votes())


@query(
    "a8_repeated_values",
    "SELECT name, maker, count(*) AS occurrences FROM catalog GROUP BY ALL HAVING count(*) > 1",
)
def _(v: Views) -> DataFrame:
    return A.repeated_values(v.catalog(), ["name", "maker"])


@query(
    "a9_type_transitions",
    """SELECT before, after, count(*) AS items FROM (SELECT content_type AS before, CASE match_status WHEN 'matched' THEN content_type
    WHEN 'ambiguous' THEN 'live' ELSE 'short' END AS after FROM items) WHERE before <> after GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    after = F.expr("CASE match_status WHEN 'matched' THEN content_type WHEN 'ambiguous' THEN 'live' ELSE 'short' END")
    return A.transitions(v.items().select(F.col("content_type").alias("before"), after.alias("after")))


@query(
    "a11_run_metrics",
    """SELECT count(*) AS requested, count(*) FILTER (c_nationkey < 24) AS fetched, count(*) - count(*) FILTER (c_nationkey < 24) AS failed,
    count(*) FILTER (c_nationkey < 24) / count(*) >= 0.95 AS is_successful FROM customer""",
)
def _(v: Views) -> DataFrame:
    requested = v.table("customer").selectExpr("concat('ext', c_custkey) AS external_id")
    fetched = entity_stat_rows(v).join(
        v.table("customer").where("c_nationkey < 24").selectExpr("concat('ext', c_custkey) AS external_id"), "external_id"
    )
    return A.run_metrics(requested, fetched, "external_id")


@query(
    "a12_distinct_tags",
    """SELECT item_id, count(*) AS tags, min(catalog_id) AS first_id, max(catalog_id) AS last_id FROM confirmed GROUP BY item_id""",
)
def _(v: Views) -> DataFrame:
    rows = L.catalog_tags(v.links(), v.items(), v.catalog())
    return rows.select(
        "item_id", F.size("tags").cast("long").alias("tags"),
        F.col("tags")[0]["catalog_id"].alias("first_id"), F.element_at("tags", -1)["catalog_id"].alias("last_id"),
    )


@query(
    "a14_catalog_type_counts",
    "SELECT count(*) FILTER (kind = 'pachinko') AS pachinko, count(*) FILTER (kind = 'slot') AS slot, "
    "count(*) FILTER (kind IS NULL) AS unknown FROM kinds",
)
def _(v: Views) -> DataFrame:
    return A.catalog_type_counts(v.catalog())


@query("a15_release_months", "SELECT DISTINCT strftime(release_date, '%Y-%m') AS month FROM catalog")
def _(v: Views) -> DataFrame:
    return A.release_months(v.catalog())


def _counted(source: str, key: str, name: str) -> str:
    return f"""(SELECT canonical_id, duplicate_id, CAST(sum(n) AS BIGINT) AS {name}_before, count(*) AS {name}_after,
        CAST(sum(d) AS BIGINT) AS {name}_to_move, CAST(sum(CASE WHEN d > 0 AND n > d THEN d ELSE 0 END) AS BIGINT) AS {name}_shared
        FROM (SELECT canonical_id, duplicate_id, {key}, count(*) AS n, count(*) FILTER (is_dup) AS d FROM {source} JOIN members USING (catalog_id)
        GROUP BY ALL) GROUP BY ALL)"""


_PREVIEW_COLUMNS = ", ".join(
    f"coalesce({t}_{c}, 0) AS {t}_{c}" for t in ("links", "mentions", "votes") for c in ("before", "after", "to_move", "shared")
)


@query(
    "a16_merge_preview",
    f"""WITH members AS (SELECT canonical_id, canonical_id AS catalog_id, false AS is_dup, duplicate_id FROM merge_groups
        UNION ALL SELECT canonical_id, duplicate_id, true, duplicate_id FROM merge_groups),
    parts AS (SELECT * FROM merge_groups LEFT JOIN {_counted('links', 'item_id', 'links')} USING (canonical_id, duplicate_id)
        LEFT JOIN {_counted('mentions', 'item_id', 'mentions')} USING (canonical_id, duplicate_id)
        LEFT JOIN {_counted('(SELECT *, target_id AS catalog_id FROM votes)', 'voter_id', 'votes')} USING (canonical_id, duplicate_id)
        LEFT JOIN (SELECT canonical_id, duplicate_id, count(*) FILTER (is_dup) AS judgments_to_move FROM judgments JOIN members USING (catalog_id)
            GROUP BY ALL) USING (canonical_id, duplicate_id)
        LEFT JOIN (SELECT canonical_id, duplicate_id, count(DISTINCT item_id) AS rankable_after FROM rankable JOIN members USING (catalog_id)
            GROUP BY ALL) USING (canonical_id, duplicate_id))
    SELECT canonical_id, duplicate_id, {_PREVIEW_COLUMNS}, coalesce(judgments_to_move, 0) AS judgments_to_move,
    coalesce(rankable_after, 0) AS rankable_after FROM parts""",
)
def _(v: Views) -> DataFrame:
    mentions = sinks.rebuilt_mentions(v.links(), v.items())
    return M.merge_preview(v.links(), v.items(), mentions, v.votes(), v.judgments(), merge_groups(v))


@query("a17_latest_date", "SELECT CAST(max(date) AS VARCHAR) AS latest_date FROM entity_daily")
def _(v: Views) -> DataFrame:
    return A.latest_date(v.entity_daily()).select(*text("latest_date"))


@query(
    "a18_missing_counts",
    "SELECT count(*) - count(duration_seconds) AS missing_duration_seconds, count(*) - count(live_flag) AS missing_live_flag FROM items",
)
def _(v: Views) -> DataFrame:
    return A.missing_counts(v.items(), ["duration_seconds", "live_flag"])


@query(
    "a19_mean_per_item",
    """SELECT catalog_id, CASE WHEN n > 0 THEN CAST(floor(CAST(views AS DOUBLE) / n + 0.5) AS BIGINT) ELSE 0 END AS mean_views FROM
    (SELECT catalog_id, count(item_id) AS n, coalesce(sum(view_count), 0) AS views FROM catalog LEFT JOIN
    (SELECT catalog_id, item_id, view_count FROM rankable) USING (catalog_id) GROUP BY ALL)""",
)
def _(v: Views) -> DataFrame:
    pairs = L.confirmed_pairs(v.links(), v.items(), rankable=True)
    stats = pairs.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"), F.sum("view_count").alias("views"))
    rows = L.with_defaults(v.catalog().select("catalog_id"), stats, "catalog_id", ["n", "views"])
    return rows.select("catalog_id", mean_per_item(F.col("views"), F.col("n")).alias("mean_views"))


def _children(source: str, key: str, name: str) -> str:
    return f"(SELECT catalog_id, count(*) AS {name}, count(DISTINCT {key}) AS distinct_{name} FROM {source} GROUP BY 1)"


@query(
    "a20_child_counts",
    f"""SELECT catalog_id, coalesce(links, 0) AS links, coalesce(distinct_links, 0) AS distinct_links, coalesce(votes, 0) AS votes,
    coalesce(distinct_votes, 0) AS distinct_votes FROM catalog LEFT JOIN {_children('links', 'item_id', 'links')} USING (catalog_id)
    LEFT JOIN {_children('(SELECT *, target_id AS catalog_id FROM votes)', 'voter_id', 'votes')} USING (catalog_id)""",
)
def _(v: Views) -> DataFrame:
    votes = v.votes().withColumnRenamed("target_id", "catalog_id")
    return A.child_counts(v.catalog(), {"links": (v.links(), "item_id"), "votes": (votes, "voter_id")})


@query(
    "a21_residual_references",
    """SELECT 'links' AS child, count(*) AS rows FROM links WHERE catalog_id IN (SELECT duplicate_id FROM merge_groups)
    UNION ALL SELECT 'judgments', count(*) FROM judgments WHERE catalog_id IN (SELECT duplicate_id FROM merge_groups)""",
)
def _(v: Views) -> DataFrame:
    removed = merge_groups(v).select(F.col("duplicate_id").alias("catalog_id"))
    return A.residual_references(removed, {"links": v.links(), "judgments": v.judgments()})


_VALID = """SELECT * FROM votes WHERE vote_type IN ('want_to_play', 'wait_and_see', 'not_interested') AND length(voter_id) >= 8
    AND target_id IN (SELECT catalog_id FROM catalog WHERE type IS NOT NULL)"""


@query(
    "job6_vote_upsert",
    f"""SELECT target_id, voter_id, arg_max(vote_type, row(created_at, vote_id)) AS vote_type FROM ({_VALID}) GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    targets = v.catalog().where("type IS NOT NULL").select(F.col("catalog_id").alias("target_id"))
    votes = accepted_votes(v.votes(), targets)
    early = F.col("created_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return vote_upsert(votes.where(early), votes.where(~early)).drop("created_at")
