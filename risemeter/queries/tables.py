"""Queries for scans, payload sources and table updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.identity import normalize_type
from risemeter.operators.links import first_by
from risemeter.operators.tallies import repeated_values
from risemeter.plans.ingest import resolve_handles
from risemeter.queries.registry import query, text, whole
from risemeter.schemas import key_problems
from risemeter.sources import payloads, seeds, sinks
from risemeter.sources.tables import active_entities, lookup, scan
from risemeter.views import Views


@query(
    "src1_active_entities",
    "SELECT entity_id, name, category FROM entities WHERE active",
)
def _(v: Views) -> DataFrame:
    return active_entities(v.entities()).select("entity_id", "name", "category")


# Tables of the full scan and their columns by kind: numbers are summed as whole numbers, texts by length, times by second.
_SCANNED = {
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"], []),
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]),
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"],
        ["l_shipdate"],
    ),
}


@query(
    "src2_full_scan",
    " UNION ALL ".join(
        f"SELECT '{table}' AS source, '{c}' AS name, count({c}) AS n, CAST(sum({total}) AS BIGINT) AS total FROM {table}"
        for table, kinds in _SCANNED.items()
        for columns, form in zip(kinds, ("floor({} * 100)::BIGINT", "length({})", "epoch({})::BIGINT"), strict=True)
        for c in columns
        for total in [form.format(c)]
    ),
)
def _(v: Views) -> DataFrame:
    """Every column of the tables is read; one pass per table."""
    parts = []
    for table, (numbers, texts, times) in _SCANNED.items():
        whole_ = {c: F.floor(F.col(c) * 100).cast("long") for c in numbers} | {c: F.length(c).cast("long") for c in texts}
        whole_ |= {c: F.unix_seconds(F.col(c).cast("timestamp")) for c in times}
        rows = scan(v.spark, f"{v.folder}/{table}.parquet", list(whole_))
        sums = rows.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.sum(x).alias("total")) for c, x in whole_.items()]).alias("c"))
        parts.append(sums.select(F.lit(table).alias("source"), F.inline("c")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "src3_key_lookup",
    "SELECT item_id, entity_id, view_count FROM items WHERE entity_id = 7",
)
def _(v: Views) -> DataFrame:
    return lookup(v.items(), "entity_id", 7).select("item_id", "entity_id", "view_count")


_THUMBS = {
    "high": "CASE WHEN c_nationkey < 8 THEN named_struct('url', concat('h', c_custkey)) END",
    "medium": "CASE WHEN c_nationkey < 15 THEN named_struct('url', concat('m', c_custkey)) END",
    "default": "CASE WHEN c_nationkey < 22 THEN named_struct('url', concat('d', c_custkey)) END",
}
_THUMBNAILS = f"named_struct('high', {_THUMBS['high']}, 'medium', {_THUMBS['medium']}, 'default', {_THUMBS['default']})"
_THUMBNAIL_SQL = (
    "CASE WHEN c_nationkey < 8 THEN 'h' || c_custkey WHEN c_nationkey < 15 THEN 'm' || c_custkey "
    "WHEN c_nationkey < 22 THEN 'd' || c_custkey END"
)


def entity_payloads(v: Views) -> DataFrame:
    """One JSON response per customer in the form of a statistics answer."""
    return v.table("customer").selectExpr(
        f"""to_json(named_struct('items', array(named_struct('id', concat('ext', c_custkey), 'snippet', named_struct(
        'title', CASE WHEN c_nationkey < 23 THEN c_name END, 'publishedAt', '2020-01-01T00:00:00Z', 'thumbnails', {_THUMBNAILS}),
        'statistics', named_struct('subscriberCount', CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING)
        WHEN c_acctbal > -500 THEN '' END, 'viewCount', CAST(c_custkey * 10 AS STRING), 'videoCount', CASE WHEN c_nationkey > 3
        THEN CAST(c_nationkey AS STRING) END, 'hiddenSubscriberCount', c_nationkey = 9))))) AS payload"""
    )


def entity_stat_rows(v: Views) -> DataFrame:
    return payloads.entity_stats(payloads.parse_payloads(entity_payloads(v), "payload", payloads.ENTITY_ITEM))


_STATS_SQL = f"""SELECT 'ext' || c_custkey AS external_id, CASE WHEN c_nationkey < 23 THEN c_name ELSE 'Unknown' END AS name,
    {_THUMBNAIL_SQL} AS thumbnail_url, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE 0 END
    AS subscriber_count, c_custkey * 10 AS view_count, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS BIGINT) ELSE 0 END
    AS video_count FROM customer"""


@query("src4_entity_stats", _STATS_SQL)
def _(v: Views) -> DataFrame:
    return entity_stat_rows(v)


def upload_payloads(v: Views) -> DataFrame:
    return v.items().selectExpr(
        "entity_id",
        """to_json(named_struct('items', array(named_struct('snippet', named_struct('title',
        CASE WHEN content_type <> 'unknown' THEN title END, 'publishedAt', date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        'resourceId', named_struct('videoId', CAST(item_id AS STRING)), 'thumbnails', named_struct('medium',
        named_struct('url', concat('m', item_id)))))))) AS payload""",
    )


def upload_rows(v: Views) -> DataFrame:
    return payloads.uploads(payloads.parse_payloads(upload_payloads(v), "payload", payloads.UPLOAD_ITEM))


@query(
    "src5_uploads",
    """SELECT entity_id, CAST(item_id AS VARCHAR) AS item_id, CASE WHEN content_type <> 'unknown' THEN title ELSE '' END AS title,
    strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at, 'm' || item_id AS thumbnail_url FROM items""",
)
def _(v: Views) -> DataFrame:
    return upload_rows(v)


def item_payloads(v: Views) -> DataFrame:
    return v.items().selectExpr(
        """to_json(named_struct('items', array(named_struct('id', CAST(item_id AS STRING), 'statistics', named_struct(
        'viewCount', CAST(view_count AS STRING), 'likeCount', CASE WHEN like_count > 500 THEN CAST(like_count AS STRING) END,
        'commentCount', CAST(comment_count AS STRING)), 'contentDetails', named_struct('duration',
        CASE WHEN duration_seconds >= 60 THEN concat('PT1M', duration_seconds - 60, 'S') WHEN duration_seconds > 10
        THEN concat('PT', duration_seconds, 'S') WHEN duration_seconds IS NOT NULL THEN 'P1D' END),
        'snippet', named_struct('liveBroadcastContent', live_flag), 'liveStreamingDetails',
        CASE WHEN content_type = 'short' THEN named_struct('actualStartTime', '2026-07-01T12:00:00Z') END)))) AS payload"""
    )


def item_stat_rows(v: Views) -> DataFrame:
    return payloads.item_stats(payloads.parse_payloads(item_payloads(v), "payload", payloads.VIDEO_ITEM))


@query(
    "src6_item_stats",
    """SELECT CAST(item_id AS VARCHAR) AS item_id, view_count, CASE WHEN like_count > 500 THEN like_count ELSE 0 END AS like_count,
    comment_count, CASE WHEN duration_seconds > 10 THEN duration_seconds END AS duration_seconds, live_flag,
    CASE WHEN content_type = 'short' THEN '2026-07-01T12:00:00Z' END AS started_at FROM items""",
)
def _(v: Views) -> DataFrame:
    rows = item_stat_rows(v)
    return rows.withColumn("started_at", F.col("live_details.actualStartTime")).drop("live_details")


def search_rows(v: Views) -> DataFrame:
    """Each link as a search hit: the method is the query, entities are suppliers."""
    answers = v.table("lineitem").selectExpr(
        "concat('query ', l_returnflag) AS query",
        """to_json(named_struct('items', array(named_struct('id', CASE WHEN l_tax > 0 THEN named_struct('videoId',
        CAST(l_orderkey AS STRING)) END, 'snippet', named_struct('channelId', concat('s', l_suppkey), 'channelTitle',
        concat('Supplier ', l_suppkey), 'title', concat('hit ', l_orderkey), 'publishedAt',
        date_format(make_timestamp(2024, 1, 1, 0, 0, 0) + make_dt_interval(CAST(l_orderkey AS INT)), "yyyy-MM-dd'T'HH:mm:ss'Z'")))))) AS payload""",
    )
    return payloads.search_hits(payloads.parse_payloads(answers, "payload", payloads.SEARCH_ITEM))


def hit_rows(v: Views) -> DataFrame:
    """The same hits without the way through JSON, for the queries behind the source."""
    return v.table("lineitem").where("l_tax > 0").selectExpr(
        "concat('query ', l_returnflag) AS query", "CAST(l_orderkey AS STRING) AS item_id", "concat('s', l_suppkey) AS external_id",
        "concat('Supplier ', l_suppkey) AS entity_title", "concat('hit ', l_orderkey) AS title",
        "date_format(make_timestamp(2024, 1, 1, 0, 0, 0) + make_dt_interval(CAST(l_orderkey AS INT)), "
        "\"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS published_at",
    )


HITS_SQL = """SELECT 'query ' || l_returnflag AS query, CAST(l_orderkey AS VARCHAR) AS item_id, 's' || l_suppkey AS external_id,
    'Supplier ' || l_suppkey AS entity_title, 'hit ' || l_orderkey AS title,
    strftime(TIMESTAMP '2024-01-01' + to_days(CAST(l_orderkey AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS published_at,
    'https://www.youtube.com/watch?v=' || l_orderkey AS item_url FROM lineitem WHERE l_tax > 0"""


@query("src7_search_hits", HITS_SQL)
def _(v: Views) -> DataFrame:
    return search_rows(v)


def detail_rows(v: Views) -> DataFrame:
    return payloads.entity_details(payloads.parse_payloads(entity_payloads(v), "payload", payloads.ENTITY_ITEM))


@query(
    "src8_entity_details",
    f"""SELECT 'ext' || c_custkey AS external_id, CASE WHEN c_nationkey < 23 THEN c_name ELSE 'Unknown' END AS title,
    'https://www.youtube.com/channel/ext' || c_custkey AS entity_url, {_THUMBNAIL_SQL} AS thumbnail_url,
    CASE WHEN c_nationkey <> 9 AND c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS subscriber_count,
    c_custkey * 10 AS view_count, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS BIGINT) ELSE 0 END AS video_count,
    '2020-01-01T00:00:00Z' AS published_at, '' AS description FROM customer""",
)
def _(v: Views) -> DataFrame:
    return detail_rows(v)


@query(
    "src9_seed_list",
    "SELECT name, maker, kind, count(*) AS n FROM kinds GROUP BY ALL",
)
def _(v: Views) -> DataFrame:
    lines = v.catalog().select(F.to_json(F.struct("name", "maker", "type", "release_date")).alias("line"))
    rows = lines.select(F.from_json("line", seeds.CATALOG_SEED).alias("s")).select("s.*")
    return rows.groupBy("name", "maker", normalize_type(F.col("type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def suggestion_files(v: Views) -> DataFrame:
    """Alias files in their JSON form, one per entry, so that no text grows with the catalog."""
    suggestion = F.struct(
        F.col("catalog_id").alias("machineId"),
        F.col("short_name").alias("shortName"),
        F.array(F.concat(F.col("name"), F.lit("!"))).alias("aliases"),
        F.array("maker").alias("excludeTerms"),
        F.when(F.col("type").isNotNull(), F.col("type") == "slot").alias("approved"),
    )
    return v.catalog().select(F.to_json(F.struct(F.array(suggestion).alias("suggestions"))).alias("body"))


def suggestion_rows(v: Views) -> DataFrame:
    """The suggestions of these files, read back from JSON."""
    return seeds.alias_suggestions(suggestion_files(v).select(F.from_json("body", seeds.ALIAS_FILE).alias("f")).select("f.*"))


@query(
    "src10_approved_aliases",
    """SELECT catalog_id, short_name, name || '!' AS aliases, maker AS exclude_terms FROM catalog WHERE type = 'slot'""",
)
def _(v: Views) -> DataFrame:
    rows = seeds.approved_aliases(suggestion_rows(v)).drop("position")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("aliases", "exclude_terms")})


# Observations before the 20th are stored already, later ones come in.
_STORED = "date < DATE '2024-01-20'"


@query(
    "snk1_new_snapshots",
    """SELECT entity_id, CAST(date AS VARCHAR) AS date, subscriber_count FROM (SELECT *, row_number() OVER (PARTITION BY
    entity_id, date ORDER BY collected_at, event_id) AS rn FROM observations WHERE date >= DATE '2024-01-15') o WHERE rn = 1
    AND NOT EXISTS (SELECT 1 FROM observations s WHERE s.date < DATE '2024-01-20' AND s.entity_id = o.entity_id AND s.date = o.date)""",
)
def _(v: Views) -> DataFrame:
    rows = v.observations()
    stored = rows.where(_STORED).select("entity_id", "date").distinct()
    new = sinks.new_snapshots(
        stored, rows.where("date >= DATE '2024-01-15'"), "entity_id", F.struct("collected_at", "event_id")
    )
    return new.select("entity_id", *text("date"), "subscriber_count")


@query(
    "snk1_snapshot_outcome",
    """SELECT count(*) FILTER (d) AS inserted, CAST(sum(n) - count(*) FILTER (d) AS BIGINT) AS skipped FROM (SELECT entity_id, date,
    count(*) AS n, date >= DATE '2024-01-20' AS d FROM observations WHERE date >= DATE '2024-01-15' GROUP BY ALL)""",
)
def _(v: Views) -> DataFrame:
    rows = v.observations()
    return sinks.snapshot_outcome(rows.where(_STORED), rows.where("date >= DATE '2024-01-15'"), "entity_id")


def _next_items(v: Views) -> DataFrame:
    """A later version of the items: some gained views, some are new, some are gone."""
    rows = v.items().where("NOT (content_type = 'live' AND match_status = 'unmatched')")
    grown = F.when(F.col("content_type") == "short", F.col("view_count") + 10).otherwise(F.col("view_count"))
    return rows.withColumn("view_count", grown)


def _stored_items(v: Views) -> DataFrame:
    return v.items().where("NOT (content_type = 'promotion' AND match_status = 'matched')")


_COMPARED = ["title", "thumbnail_url", "view_count", "like_count", "comment_count", "content_type", "duration_seconds", "live_flag"]


@query(
    "snk2_item_upsert_actions",
    """SELECT item_id, CASE WHEN content_type = 'promotion' AND match_status = 'matched' THEN 'insert' WHEN content_type = 'live'
    AND match_status = 'unmatched' THEN 'absent' WHEN content_type = 'short' THEN 'update' ELSE 'unchanged' END AS action
    FROM items""",
)
def _(v: Views) -> DataFrame:
    return sinks.upsert_actions(_stored_items(v), _next_items(v), ["item_id"], _COMPARED).select("item_id", "action")


@query(
    "snk2_item_upsert",
    """SELECT item_id, entity_id, CASE WHEN content_type = 'short' THEN view_count + 10 ELSE view_count END AS view_count,
    match_status FROM items""",
)
def _(v: Views) -> DataFrame:
    actions = sinks.upsert_actions(_stored_items(v), _next_items(v), ["item_id"], _COMPARED)
    return sinks.apply_actions(actions, ["item_id"], ["entity_id", "view_count", "match_status"], keep=["match_status"])


@query(
    "snk3_refreshed_metadata",
    f"""SELECT entity_id, coalesce(s.name, e.name) AS name, s.thumbnail_url, s.name IS NOT NULL AND (s.name <> e.name OR
    s.thumbnail_url IS NOT NULL) AS refreshed FROM entities e LEFT JOIN ({_STATS_SQL}) s USING (external_id)""",
)
def _(v: Views) -> DataFrame:
    rows = sinks.refreshed_metadata(v.entities(), entity_stat_rows(v))
    return rows.select("entity_id", "name", "thumbnail_url", "refreshed")


def _new_matches(v: Views) -> DataFrame:
    """Matches as a new run would find them: the stored alias links, now as names of the next entry."""
    return v.links().where("method = 'alias'").selectExpr(
        "item_id", "catalog_id + 1 AS catalog_id", "'exact_name' AS method", "100 AS confidence"
    ).distinct()


REPLACED_SQL = """SELECT item_id, catalog_id, method, CAST(confidence AS BIGINT) AS confidence FROM links
    WHERE method NOT IN ('exact_name', 'alias')
    UNION ALL SELECT DISTINCT item_id, catalog_id + 1, 'exact_name', 100 FROM links l WHERE method = 'alias' AND NOT EXISTS
    (SELECT 1 FROM links m WHERE m.method IN ('manual', 'manual_excluded') AND m.item_id = l.item_id
    AND m.catalog_id = l.catalog_id + 1)"""


@query("snk4_replaced_auto_links", REPLACED_SQL)
def _(v: Views) -> DataFrame:
    rows = sinks.replaced_auto_links(v.links(), _new_matches(v), v.items())
    return rows.select("item_id", "catalog_id", "method", *whole("confidence"))


@query(
    "snk4_status_after_linking",
    """SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM links WHERE method <> 'manual_excluded') THEN 'matched'
    ELSE 'unmatched' END AS match_status FROM items""",
)
def _(v: Views) -> DataFrame:
    return sinks.status_after_linking(v.items(), v.links()).select("item_id", "match_status")


@query(
    "snk5_rebuilt_mentions",
    "SELECT item_id, catalog_id, entity_id, title, view_count, like_count, comment_count FROM mentions",
)
def _(v: Views) -> DataFrame:
    return sinks.rebuilt_mentions(v.links(), v.items()).drop("published_at")


@query(
    "snk6_mention_changes",
    """SELECT action, count(*) AS n FROM (SELECT CASE WHEN content_type = 'promotion' AND match_status = 'matched' THEN 'insert'
    WHEN content_type = 'live' AND match_status = 'unmatched' THEN 'absent' WHEN content_type = 'short' THEN 'update'
    ELSE 'unchanged' END AS action FROM mentions JOIN items USING (item_id)) GROUP BY action""",
)
def _(v: Views) -> DataFrame:
    stored = sinks.rebuilt_mentions(v.links(), _stored_items(v))
    changes = sinks.mention_changes(stored, sinks.rebuilt_mentions(v.links(), _next_items(v)))
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk8_latest_votes",
    """SELECT target_id, voter_id, arg_max(vote_type, ts_key) AS vote_type FROM (SELECT *, row(created_at, vote_id) AS ts_key
    FROM votes) GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return sinks.latest_votes(v.votes()).drop("created_at")


@query(
    "snk10_repeated_link_keys",
    "SELECT item_id, catalog_id, count(*) AS occurrences FROM links GROUP BY ALL HAVING count(*) > 1",
)
def _(v: Views) -> DataFrame:
    return repeated_values(v.links(), ["item_id", "catalog_id"])


@query(
    "snk11_children_of_parents",
    "SELECT item_id, entity_id FROM items WHERE entity_id IN (SELECT entity_id FROM entities WHERE active)",
)
def _(v: Views) -> DataFrame:
    return sinks.children_of(v.items(), active_entities(v.entities()), "entity_id").select("item_id", "entity_id")


@query(
    "snk11_cleared_references",
    """SELECT judgment_id, item_id, CASE WHEN catalog_id IN (SELECT catalog_id FROM catalog WHERE type IS NOT NULL) THEN catalog_id END
    AS catalog_id FROM judgments""",
)
def _(v: Views) -> DataFrame:
    kept = v.catalog().where("type IS NOT NULL")
    return sinks.cleared_references(v.judgments(), kept, "catalog_id").select("judgment_id", "item_id", "catalog_id")


@query(
    "snk12_without_entities",
    """SELECT entity_id, CAST(date AS VARCHAR) AS date FROM entity_daily WHERE entity_id NOT IN (SELECT entity_id FROM entities
    WHERE handle IN ('@h3', '@h8', '@h21', '@h34'))""",
)
def _(v: Views) -> DataFrame:
    rows = sinks.without_entities(v.entity_daily(), v.entities(), ["@h3", "@h8", "@h21", "@h34"])
    return rows.select("entity_id", *text("date"))


@query(
    "job8_resolved_handles",
    """SELECT entity_id, CASE WHEN active AND external_id IS NULL AND handle IS NOT NULL THEN 'found' || entity_id ELSE external_id
    END AS external_id, active AND external_id IS NULL AND handle IS NOT NULL AS resolved FROM entities""",
)
def _(v: Views) -> DataFrame:
    answers = v.entities().where("handle IS NOT NULL").selectExpr(
        "handle", "concat('found', entity_id) AS external_id", "name", "thumbnail_url"
    )
    return resolve_handles(v.entities(), answers).select("entity_id", "external_id", "resolved")


@query(
    "snk8_first_rows",
    """SELECT target_id, voter_id, arg_min(vote_type, vote_id) AS vote_type, min(vote_id) AS vote_id FROM votes GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return first_by(v.votes().drop("created_at"), ["target_id", "voter_id"], F.struct("vote_id"))


@query(
    "snk10_key_problems",
    """SELECT 'links' AS table, item_id || '|' || catalog_id AS key, count(*) AS occurrences FROM links GROUP BY item_id, catalog_id
    HAVING count(*) > 1 UNION ALL SELECT 'catalog_votes', target_id || '|' || voter_id, count(*) FROM votes
    GROUP BY target_id, voter_id HAVING count(*) > 1""",
)
def _(v: Views) -> DataFrame:
    return key_problems({"links": v.links(), "catalog_votes": v.votes(), "entities": v.entities(), "item_snapshots": v.item_daily()})
