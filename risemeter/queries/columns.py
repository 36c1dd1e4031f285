"""Queries for the column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.functions import content, dates, identity, judgments, misc, numbers, text as T
from risemeter.plans.items import item_trends
from risemeter.plans.votes import vote_outcomes
from risemeter.queries.joins import _KEY, _norm, identity_sql
from risemeter.queries.registry import query
from risemeter.views import Views, fixed_sql, percent_sql


@query("sf1_normalize_text", f"SELECT doc_id, md5({_norm('text')}) AS digest, length({_norm('text')}) AS n FROM documents")
def _(v: Views) -> DataFrame:
    plain = T.normalize_text(F.col("text"))
    return v.table("documents").select("doc_id", F.md5(plain).alias("digest"), *[F.length(plain).cast("long").alias("n")])


_SAFE = "(length({n}) >= {any} AND (NOT regexp_full_match({n}, '[a-z0-9]+') OR length({n}) >= {ascii}))"


@query(
    "sf2_safe_terms",
    f"""SELECT p_partkey AS catalog_id, {_SAFE.format(n=_norm('p_name'), any=4, ascii=6)} AS safe_name,
    {_SAFE.format(n=_norm('substr(p_name, 1, 5)'), any=4, ascii=6)} AS safe_part,
    {_SAFE.format(n=_norm('substr(p_name, 1, 5)'), any=3, ascii=5)} AS safe_token FROM part""",
)
def _(v: Views) -> DataFrame:
    name = T.normalize_text(F.col("p_name"))
    part = T.normalize_text(F.substring("p_name", 1, 5))
    return v.table("part").select(
        F.col("p_partkey").alias("catalog_id"),
        T.is_safe_term(name).alias("safe_name"),
        T.is_safe_term(part).alias("safe_part"),
        T.is_safe_token(part).alias("safe_token"),
    )


@query(
    "sf3_weak_tokens",
    f"""SELECT doc_id, token, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text,
    '[\\s・･\\-_()\\[\\]【】「」『』]+')) AS token FROM documents) WHERE {_SAFE.format(n=_norm('token'), any=3, ascii=5)} GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    tokens = v.table("documents").select("doc_id", F.explode(T.weak_tokens(F.array("text"))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sf4_catalog_terms",
    """SELECT catalog_id, array_to_string(list_filter(list_concat([name], list_concat(CASE WHEN short_name IS NULL THEN [] ELSE
    [short_name] END, list_concat(aliases, coalesce(unique_aliases, [])))), lambda x: x <> ''), '|') AS terms
    FROM catalog""",
)
def _(v: Views) -> DataFrame:
    # The views hold no repeated terms, so the distinct list equals the plain one.
    terms = T.catalog_terms(F.array("name", "short_name"), F.col("aliases"), F.col("unique_aliases"))
    return v.catalog().select("catalog_id", F.array_join(terms, "|").alias("terms"))


@query(
    "sf5_normalize_name",
    f"SELECT doc_id, md5({identity_sql('text', 'source', 'NULL', 'NULL')}) AS digest FROM documents",
)
def _(v: Views) -> DataFrame:
    rows = v.table("documents")
    key = F.concat(identity.normalize_name(F.col("text")), F.lit("|"), identity.normalize_maker(F.col("source")), F.lit("||"))
    return rows.select("doc_id", F.md5(key).alias("digest"))


@query(
    "sf6_normalize_maker",
    "SELECT p_partkey AS catalog_id, CASE WHEN p_size = 1 THEN 'おっけー' WHEN p_size = 2 THEN '京楽産業' WHEN p_size = 3 THEN '' "
    "ELSE lower(replace(p_brand, ' ', '')) END AS maker FROM part",
)
def _(v: Views) -> DataFrame:
    raw = (
        F.when(F.col("p_size") == 1, "オッケー.").when(F.col("p_size") == 2, "京 楽").when(F.col("p_size") == 3, F.lit(None))
        .otherwise(F.col("p_brand"))
    )
    return v.table("part").select(F.col("p_partkey").alias("catalog_id"), identity.normalize_maker(raw).alias("maker"))


@query(
    "sf7_identity_key",
    f"""SELECT catalog_id, CASE WHEN name = 'small ring' THEN replace({_KEY.replace('lower(name)', "lower('blue bolt 2')")}, lower(maker), 'canonical')
    ELSE {_KEY} END AS identity_key FROM kinds""",
)
def _(v: Views) -> DataFrame:
    reviewed = v.catalog().where("name = 'small ring'").selectExpr(
        "'Small-Ring' AS alias", "'blue bolt II' AS canonical_name", "'Canonical' AS canonical_maker"
    )
    return identity.with_identity_key(v.catalog(), reviewed).select("catalog_id", "identity_key")


@query("sf8_normalize_type", "SELECT catalog_id, kind FROM kinds")
def _(v: Views) -> DataFrame:
    return v.catalog().select("catalog_id", identity.normalize_type(F.col("type")).alias("kind"))


@query(
    "sf8_migrated_type",
    "SELECT catalog_id, CASE WHEN catalog_id < 40 AND type IS NULL THEN 'pachinko' ELSE coalesce(kind, type) END AS type FROM kinds",
)
def _(v: Views) -> DataFrame:
    name = F.when(F.col("catalog_id") < 40, F.concat(F.lit("デカスタeベルセルク無双 "), F.col("name"))).otherwise(F.col("name"))
    return v.catalog().select("catalog_id", identity.migrate_type(F.col("type"), name).alias("type"))


@query(
    "sf9_parse_duration",
    """SELECT o_orderkey AS item_id, CASE WHEN o_totalprice > 400000 THEN NULL WHEN o_totalprice > 300000 THEN 0
    WHEN o_totalprice > 200000 THEN o_custkey * 3600 + 5 ELSE o_custkey * 3600 + 60 + o_custkey END AS seconds FROM orders""",
)
def _(v: Views) -> DataFrame:
    form = F.expr(
        """CASE WHEN o_totalprice > 400000 THEN concat('P1DT', o_custkey, 'H') WHEN o_totalprice > 300000 THEN 'PT'
        WHEN o_totalprice > 200000 THEN concat('PT', o_custkey, 'H5S') ELSE concat('PT', o_custkey, 'H1M', o_custkey, 'S') END"""
    )
    return v.table("orders").select(F.col("o_orderkey").alias("item_id"), content.parse_duration(form).alias("seconds"))


# The cascade over the view's titles: official categories are media, manufacturer and hall.
CLASS_SQL = """CASE WHEN category IN ('media', 'manufacturer', 'hall') AND content_type IN ('live', 'unknown') THEN 'promotion'
    WHEN live_flag = 'Live' THEN 'live' WHEN stored = 'live' THEN 'live'
    WHEN started AND content_type = 'short' THEN 'live'
    WHEN content_type = 'standard' THEN 'short' WHEN duration_seconds BETWEEN 1 AND 60 THEN 'short' ELSE 'standard' END"""
REASON_SQL = """CASE WHEN category IN ('media', 'manufacturer', 'hall') AND content_type = 'live' THEN
    'official channel with strong promotional title signal' WHEN category IN ('media', 'manufacturer', 'hall')
    AND content_type = 'unknown' THEN 'official channel with bounded CM/PV title signal'
    WHEN live_flag = 'Live' THEN 'youtube liveBroadcastContent=live'
    WHEN stored = 'live' THEN 'existing live classification retained because live metadata is inconclusive'
    WHEN started AND content_type = 'short' THEN 'youtube broadcast timestamp plus explicit live title signal'
    WHEN content_type = 'standard' THEN 'shorts title hashtag'
    WHEN duration_seconds BETWEEN 1 AND 60 THEN 'duration is 60 seconds or less' ELSE 'default long-form classification' END"""


@query(
    "sf10_content_class",
    f"""SELECT item_id, {CLASS_SQL} AS content_type, {REASON_SQL} AS reason, CASE {CLASS_SQL} WHEN 'promotion' THEN 90 WHEN 'live' THEN 95
    WHEN 'short' THEN 75 ELSE 60 END AS confidence FROM (SELECT i.*, category, like_count > 3000 AS started,
    CASE WHEN comment_count > 480 THEN 'live' END AS stored FROM items i JOIN entities USING (entity_id))""",
)
def _(v: Views) -> DataFrame:
    rows = v.items().join(v.entities().select("entity_id", "category"), "entity_id")
    none = F.lit(None).cast("string")
    started = F.when(F.col("like_count") > 3000, "2026-07-01T12:00:00Z")
    stored = F.when(F.col("comment_count") > 480, "live")
    verdict = content.classify_content(
        F.col("title"), F.col("duration_seconds"), F.col("live_flag"), none, started, F.lit(""), F.col("category"), stored
    )
    return rows.select("item_id", verdict.alias("c")).select("item_id", "c.*").withColumn(
        "confidence", F.col("confidence").cast("long")
    )


_SCORE = """n * 20 + n_ref * 15 + log10(CAST(coalesce(subs, 0) AS DOUBLE) + 1.0) * 3
    + CASE WHEN newest IS NULL THEN greatest(0.0, CAST(20.0 - 60.0 / 3 AS DOUBLE))
    ELSE greatest(0.0, CAST(20.0 AS DOUBLE) - greatest(0.0, CAST(epoch_ms(TIMESTAMP '2001-08-01') - epoch_ms(newest) AS DOUBLE)
    / 86400000) / 3) END"""


@query(
    "sf11_candidate_score",
    f"""SELECT entity_id, {fixed_sql(f'({_SCORE})', 3)} AS score FROM (SELECT o_custkey AS entity_id, count(*) AS n,
    count(DISTINCT o_orderpriority) AS n_ref, CASE WHEN o_custkey > 20 THEN o_custkey * 37 END AS subs,
    max(CASE WHEN o_custkey > 10 THEN o_orderdate END) AS newest FROM orders GROUP BY o_custkey)""",
)
def _(v: Views) -> DataFrame:
    rows = v.table("orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_orderpriority").alias("n_ref"),
        F.max(F.when(F.col("o_custkey") > 10, F.col("o_orderdate").cast("timestamp"))).alias("newest"),
    )
    subscribers = F.when(F.col("entity_id") > 20, F.col("entity_id") * 37)
    now = F.lit("2001-08-01 00:00:00").cast("timestamp")
    score = numbers.candidate_score(F.col("n"), F.col("n_ref"), subscribers, F.col("newest"), now)
    return rows.select("entity_id", score.alias("score"))


@query("sf12_local_day", "SELECT event_id, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", dates.local_day(F.col("ts")).cast("string").alias("day"))


@query("sf13_monday", "SELECT o_orderkey AS item_id, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS monday FROM orders")
def _(v: Views) -> DataFrame:
    return v.table("orders").select(
        F.col("o_orderkey").alias("item_id"), dates.monday_of(F.col("o_orderdate")).cast("string").alias("monday")
    )


@query(
    "sf14_date_arithmetic",
    """SELECT l_orderkey, l_linenumber, greatest(0, CAST(CAST(l_shipdate AS DATE) - DATE '1998-01-01' AS BIGINT)) AS n_days,
    abs(CAST(CAST(l_shipdate AS DATE) - DATE '1998-01-01' AS BIGINT)) AS gap, CAST(CAST(l_shipdate AS DATE) - 7 AS VARCHAR) AS earlier
    FROM lineitem""",
)
def _(v: Views) -> DataFrame:
    day, fixed = F.to_date("l_shipdate"), F.lit("1998-01-01").cast("date")
    return v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        dates.days_between(fixed, day).cast("long").alias("n_days"),
        dates.day_gap(fixed, day).cast("long").alias("gap"),
        dates.shift_day(day, -7).cast("string").alias("earlier"),
    )


@query(
    "sf15_delta_percent",
    f"SELECT item_id, {percent_sql('(like_count - comment_count * 9)', '(view_count - 30000)')} AS pct FROM items",
)
def _(v: Views) -> DataFrame:
    delta = F.col("like_count") - F.col("comment_count") * 9
    return v.items().select("item_id", numbers.delta_percent(delta, F.col("view_count") - 30000).alias("pct"))


@query(
    "sf16_release_bucket",
    """SELECT link_id, item_id, CASE WHEN kind IS NULL OR status = 'unmatched' THEN 'unclassified' WHEN published_at < release_date
    THEN 'pre_release' WHEN published_at <= release_date + INTERVAL 7 DAY THEN 'first_7_days' ELSE 'after_release' END AS bucket
    FROM (SELECT link_id, item_id, kind, release_date, published_at, match_status AS status FROM links JOIN items USING (item_id)
    JOIN kinds USING (catalog_id))""",
)
def _(v: Views) -> DataFrame:
    entries = v.catalog().select("catalog_id", "release_date", identity.normalize_type(F.col("type")).alias("kind"))
    rows = v.links().join(v.items().select("item_id", "published_at", "match_status"), "item_id").join(entries, "catalog_id")
    published = F.when(F.col("match_status") == "unmatched", F.lit("not a date")).otherwise(F.col("published_at").cast("string"))
    release = F.when(F.col("kind").isNotNull(), F.col("release_date"))
    return rows.select("link_id", "item_id", dates.release_bucket(published, release).alias("bucket"))


def response_rows(v: Views) -> DataFrame:
    """Per order a batch answer: its lines as JSON elements, some of them malformed, within prose."""
    element = F.to_json(
        F.struct(
            F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_linenumber")).alias("candidateIndex"),
            F.when(F.col("l_tax") > 0.06, F.lit(None)).otherwise(F.col("l_partkey")).alias("machineId"),
            (F.col("l_discount") * 12).alias("confidence"),
            F.when(F.col("l_linestatus") == "F", F.concat(F.lit("line "), F.col("l_linenumber"))).alias("reason"),
            F.array(F.lit("term"), F.col("l_returnflag")).alias("matchedTerms"),
        )
    )
    rows = v.table("lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.when(F.col("l_suppkey") < 5, F.regexp_replace(element, '"confidence":([0-9.E-]+)', '"confidence":"$1"'))
        .otherwise(element).alias("element"),
    )
    # One answer holds the lines of one order.
    return rows.groupBy("batch_id").agg(
        F.concat(
            F.lit("Result: ["), F.array_join(F.sort_array(F.collect_list("element")), ", "), F.lit("] done")
        ).alias("response_text")
    )


# Confidence is l_discount * 12: at most 1 for discounts up to 0.08.
JUDGED_SQL = """SELECT l_orderkey AS batch_id, CAST(l_linenumber AS BIGINT) AS candidate_index,
    CASE WHEN l_tax > 0.06 THEN NULL ELSE l_partkey END AS judged_catalog_id, l_discount * 12 AS confidence,
    CASE WHEN l_linestatus = 'F' THEN 'line ' || l_linenumber ELSE '' END AS reason, 'term|' || l_returnflag AS matched_terms
    FROM lineitem WHERE l_linenumber <> 7 AND l_discount * 12 <= 1 AND l_suppkey >= 5"""


@query("sf17_parsed_judgments", JUDGED_SQL)
def _(v: Views) -> DataFrame:
    rows = judgments.parse_judgments(response_rows(v)).drop("response_text", "element")
    return rows.withColumn("matched_terms", F.array_join("matched_terms", "|"))


@query("sf18_judgment_key", "SELECT link_id, 'v1:gemini:' || item_id || ':' || catalog_id AS judgment_key FROM links")
def _(v: Views) -> DataFrame:
    return v.links().select("link_id", judgments.judgment_key(F.col("item_id"), F.col("catalog_id")).alias("judgment_key"))


@query(
    "sf19_judgment_status",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.9 THEN 'auto_linked' WHEN l_discount * 10 >= 0.7 THEN 'pending'
    ELSE 'rejected' END AS status FROM lineitem""",
)
def _(v: Views) -> DataFrame:
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", judgments.judgment_status(F.col("l_discount") * 10).alias("status")
    )


@query(
    "sf20_entity_page_url",
    """SELECT entity_id, CASE WHEN handle IS NOT NULL THEN 'https://www.youtube.com/' || handle WHEN external_id IS NOT NULL
    THEN 'https://www.youtube.com/channel/' || external_id END AS url FROM entities""",
)
def _(v: Views) -> DataFrame:
    bare = F.when(F.col("category") == "hall", F.ltrim(F.col("handle"), F.lit("@"))).otherwise(F.col("handle"))
    return v.entities().select("entity_id", misc.entity_page_url(bare, F.col("external_id")).alias("url"))


@query("sf21_fill_missing", "SELECT catalog_id, coalesce(short_name, name) AS label FROM catalog")
def _(v: Views) -> DataFrame:
    return v.catalog().select("catalog_id", misc.fill_missing(F.col("short_name"), F.col("name")).alias("label"))


@query("sf22_publish_cutoff", "SELECT item_id FROM items WHERE published_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY")
def _(v: Views) -> DataFrame:
    cutoff = dates.publish_cutoff(F.lit("2001-08-01 00:00:00").cast("timestamp"), 90)
    return v.items().where(F.col("published_at").cast("timestamp") >= cutoff).select("item_id")


@query(
    "sf23_vote_outcomes",
    """SELECT vote_id, CASE WHEN prior IS NULL THEN 'recorded' WHEN prior = vote_type THEN 'already_recorded' ELSE 'updated' END
    AS outcome FROM (SELECT *, lag(vote_type) OVER (PARTITION BY target_id, voter_id ORDER BY created_at, vote_id) AS prior FROM votes)""",
)
def _(v: Views) -> DataFrame:
    return vote_outcomes(v.votes()).select("vote_id", "outcome")


@query(
    "sf24_trend_direction",
    """SELECT item_id, CASE WHEN comparison_days <= 1 THEN 'none' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END
    AS direction FROM item_trend_1""",
)
def _(v: Views) -> DataFrame:
    rows = item_trends(v.item_daily(), 1)
    return rows.select("item_id", numbers.trend_direction(F.col("delta"), F.col("comparison_days")).alias("direction"))
