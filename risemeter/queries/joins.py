"""Queries for filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.identity import with_identity_key
from risemeter.operators import links as L, predicates as P, sets as S
from risemeter.operators.matching import MATCHING_ROLES, ambiguous_candidates, index_catalog, judged_pairs, match_titles, matching_entries, title_hits
from risemeter.operators.snapshots import period_comparisons
from risemeter.operators.tallies import catalog_stats
from risemeter.plans.items import item_trends
from risemeter.queries.registry import query, text, whole
from risemeter.queries.tables import HITS_SQL, detail_rows, hit_rows
from risemeter.views import Views, compare_sql

# -- filters ---------------------------------------------------------------


@query(
    "pf1_narrow_projection",
    """SELECT item_id AS id, title, view_count AS current_views, content_type, duration_seconds, live_flag, entity_id AS owner_id,
    name AS owner_name FROM items JOIN entities USING (entity_id)""",
)
def _(v: Views) -> DataFrame:
    return L.items_with_entities(v.items(), v.entities()).select(
        F.col("item_id").alias("id"), "title", F.col("view_count").alias("current_views"), "content_type",
        "duration_seconds", "live_flag", F.col("entity_id").alias("owner_id"), F.col("entity_name").alias("owner_name"),
    )


@query(
    "pf2_confirmed_links",
    """SELECT item_id, catalog_id, link_id FROM links JOIN items USING (item_id)
    WHERE match_status = 'matched' AND method <> 'manual_excluded'""",
)
def _(v: Views) -> DataFrame:
    return L.link_items(v.links(), v.items().select("item_id", "match_status")).where(P.is_confirmed()).select(
        "item_id", "catalog_id", "link_id"
    )


@query("pf3_rankable_items", "SELECT item_id FROM items WHERE content_type IN ('standard', 'short', 'live')")
def _(v: Views) -> DataFrame:
    return v.items().where(P.is_rankable()).select("item_id")


@query("pf4_items_of_types", "SELECT item_id, content_type FROM items WHERE content_type IN ('short', 'live')")
def _(v: Views) -> DataFrame:
    return P.of_types(v.items(), "short, live ,clips").select("item_id", "content_type")


@query("pf4_items_of_default_type", "SELECT item_id FROM items WHERE content_type = 'standard'")
def _(v: Views) -> DataFrame:
    return P.of_types(v.items(), "clips").select("item_id")


@query(
    "pf5_period_whitelist",
    " UNION ALL ".join(
        f"SELECT '{asked}' AS asked, entity_id, status, delta FROM ({compare_sql('entity_daily', 'entity_id', 'subscriber_count', period, low, high)})"
        for asked, period, low, high in (("14", 7, 5, 9), ("1", 1, 1, 3), ("", 7, 5, 9), ("mode 7d", 7, 5, 9), ("mode other", 1, 1, 3))
    ),
)
def _(v: Views) -> DataFrame:
    """Comparisons over the period that each parameter stands for."""
    periods = {"14": P.period_from("14"), "1": P.period_from("1"), "": P.period_from(None), "mode 7d": P.period_of_mode("7d"), "mode other": P.period_of_mode("other")}
    compared = period_comparisons(v.entity_daily(), "entity_id", "subscriber_count", sorted(set(periods.values())))
    asked = F.explode(F.map_from_arrays(F.array(*map(F.lit, periods)), F.array(*map(F.lit, periods.values())))).alias("asked", "_period")
    return compared.select("period", "entity_id", "status", "delta", asked).where("period = _period").select("asked", "entity_id", "status", "delta")


@query(
    "pf6_catalog_of_type_and_month",
    "SELECT catalog_id FROM kinds WHERE kind = 'slot' AND starts_with(CAST(release_date AS VARCHAR), '1996-03')",
)
def _(v: Views) -> DataFrame:
    return P.catalog_of(v.catalog(), "slot", "1996-03").select("catalog_id")


_STATS = "(SELECT catalog_id, count(*) AS item_count FROM rankable GROUP BY ALL)"


def _counted(v: Views) -> DataFrame:
    slim = v.items().select("item_id", "entity_id", "view_count", "content_type", "match_status")
    counts = L.confirmed_pairs(v.links(), slim, rankable=True).groupBy("catalog_id").agg(F.count(F.lit(1)).alias("item_count"))
    return L.with_defaults(v.catalog().select("catalog_id"), counts, "catalog_id", ["item_count"])


@query("pf7_ranked_entries", f"SELECT catalog_id, item_count FROM {_STATS}")
def _(v: Views) -> DataFrame:
    return P.ranked_only(_counted(v))


@query(
    "pf7_unranked_entries",
    "SELECT catalog_id, CAST(0 AS BIGINT) AS item_count FROM catalog WHERE catalog_id NOT IN (SELECT catalog_id FROM rankable)",
)
def _(v: Views) -> DataFrame:
    return P.unranked_only(_counted(v))


@query("pf8_small_samples", f"SELECT catalog_id, item_count BETWEEN 1 AND 2 AS is_small FROM {_STATS}")
def _(v: Views) -> DataFrame:
    return P.ranked_only(_counted(v)).select("catalog_id", P.is_small_sample(F.col("item_count")).alias("is_small"))


@query("pf9_search", "SELECT entity_id, name FROM entities WHERE contains(lower(name), 'customer#00000001') AND category = 'hall'")
def _(v: Views) -> DataFrame:
    return P.search(v.entities(), "  CUSTOMER#00000001 ", "hall").select("entity_id", "name")


@query("pf10_needs_metadata", "SELECT item_id FROM items WHERE duration_seconds IS NULL OR live_flag IS NULL")
def _(v: Views) -> DataFrame:
    return P.needs_metadata(v.items()).select("item_id")


@query(
    "pf11_fetched_only",
    "SELECT item_id FROM items WHERE (duration_seconds IS NULL OR live_flag IS NULL) AND match_status = 'matched'",
)
def _(v: Views) -> DataFrame:
    return P.fetched_only(P.needs_metadata(v.items()), P.with_status(v.items(), "matched"), True).select("item_id")


@query(
    "pf12_valid_votes",
    """SELECT vote_id FROM votes WHERE vote_type IN ('want_to_play', 'wait_and_see', 'not_interested') AND length(voter_id) BETWEEN 8
    AND 256 AND regexp_full_match(voter_id, '[A-Za-z0-9._:-]+')""",
)
def _(v: Views) -> DataFrame:
    return P.valid_votes(v.votes(), ["want_to_play", "wait_and_see", "not_interested"]).select("vote_id")


@query(
    "pf13_category_validity",
    """SELECT c_custkey AS entity_id, lower(c_mktsegment) IN ('media', 'performer', 'individual', 'manufacturer', 'hall', 'other')
    AS is_valid FROM customer""",
)
def _(v: Views) -> DataFrame:
    return v.table("customer").select(
        F.col("c_custkey").alias("entity_id"), P.valid_category(F.lower("c_mktsegment")).alias("is_valid")
    )


@query("pf14_unmatched_items", "SELECT item_id FROM items WHERE match_status = 'unmatched'")
def _(v: Views) -> DataFrame:
    return P.with_status(v.items(), "unmatched").select("item_id")


@query("pf14_pending_judgments", "SELECT judgment_id, judgment_key FROM judgments WHERE status = 'pending'")
def _(v: Views) -> DataFrame:
    return P.with_status(v.judgments(), "pending", "status").select("judgment_id", "judgment_key")


@query("pf15_growing_items", "SELECT item_id, delta FROM item_trend_1 WHERE delta > 0")
def _(v: Views) -> DataFrame:
    return P.growing(item_trends(v.item_daily(), 1)).select("item_id", "delta")


@query(
    "pf16_title_phrases",
    """SELECT doc_id AS item_id FROM documents WHERE contains(text, 'tion of the') OR contains(text, 'auaux')
    OR contains(text, '生配信の見どころ')""",
)
def _(v: Views) -> DataFrame:
    return P.mentioning(v.titles(), ["tion of the", "auaux", "生配信の見どころ"]).select("item_id")


# -- joins -----------------------------------------------------------------


@query("j1_link_items", "SELECT link_id, item_id, catalog_id, view_count FROM links JOIN items USING (item_id)")
def _(v: Views) -> DataFrame:
    return L.link_items(v.links(), v.items().select("item_id", "view_count")).select("link_id", "item_id", "catalog_id", "view_count")


@query(
    "j2_catalog_items",
    "SELECT item_id, entity_id, name AS entity_name, view_count FROM confirmed JOIN entities USING (entity_id) WHERE catalog_id = 11",
)
def _(v: Views) -> DataFrame:
    return L.catalog_items(v.links(), v.items(), v.entities(), 11).select("item_id", "entity_id", "entity_name", "view_count")


@query("j3_items_with_entities", "SELECT item_id, name AS entity_name, category FROM items JOIN entities USING (entity_id)")
def _(v: Views) -> DataFrame:
    return L.items_with_entities(v.items(), v.entities()).select("item_id", "entity_name", "category")


TAGS_SQL = """SELECT item_id, string_agg(catalog_id || ' ' || name, ', ' ORDER BY catalog_id) AS tags
    FROM confirmed JOIN catalog USING (catalog_id) GROUP BY item_id"""


def tag_text(rows: DataFrame) -> DataFrame:
    shown = F.transform("tags", lambda t: F.concat_ws(" ", t["catalog_id"].cast("string"), t["name"]))
    return rows.withColumn("tags", F.array_join(shown, ", "))


@query("j4_catalog_tags", TAGS_SQL)
def _(v: Views) -> DataFrame:
    return tag_text(L.catalog_tags(v.links(), v.items(), v.catalog()))


@query(
    "j5_stats_with_defaults",
    f"SELECT catalog_id, coalesce(item_count, 0) AS item_count FROM catalog LEFT JOIN {_STATS} USING (catalog_id)",
)
def _(v: Views) -> DataFrame:
    return _counted(v)


@query(
    "j6_details_with_fallback",
    """SELECT DISTINCT s_name AS entity_title, CASE WHEN c_nationkey < 23 THEN c_name WHEN c_custkey IS NOT NULL THEN 'Unknown' ELSE s_name
    END AS title, coalesce(c_custkey * 10, 0) AS view_count FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 30""",
)
def _(v: Views) -> DataFrame:
    asked = v.table("supplier").selectExpr("s_name AS entity_title", "concat('ext', s_suppkey * 30) AS external_id")
    found = detail_rows(v).select("external_id", "title", "view_count")
    return asked.join(found, "external_id", "left").select(
        "entity_title", F.coalesce("title", "entity_title").alias("title"), F.coalesce("view_count", F.lit(0)).alias("view_count")
    )


@query(
    "j7_selected_snapshots",
    """SELECT entity_id, CAST(date AS VARCHAR) AS date, subscriber_count FROM entity_daily
    WHERE entity_id IN (SELECT entity_id FROM entities WHERE active)""",
)
def _(v: Views) -> DataFrame:
    rows = L.only_selected(v.entity_daily(), v.entities().where("active"), "entity_id")
    return rows.select("entity_id", *text("date"), "subscriber_count")


@query(
    "j8_unregistered_hits",
    f"SELECT item_id, external_id, query FROM ({HITS_SQL}) WHERE external_id NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)",
)
def _(v: Views) -> DataFrame:
    registered = v.table("supplier").where("s_acctbal < 0").selectExpr("concat('s', s_suppkey) AS external_id")
    return L.without(hit_rows(v), registered, "external_id").select("item_id", "external_id", "query")


@query(
    "j9_unlinked_items",
    "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM links WHERE method <> 'manual_excluded')",
)
def _(v: Views) -> DataFrame:
    return L.unlinked_items(v.items(), v.links()).select("item_id")


@query(
    "j10_nearest_baseline",
    """SELECT item_id, CAST(latest_date AS VARCHAR) AS latest_date, latest_value, CAST(base_date AS VARCHAR) AS base_date, base_value
    FROM item_trend_7 WHERE is_ready""",
)
def _(v: Views) -> DataFrame:
    rows = item_trends(v.item_daily(), 7).where("is_ready")
    return rows.select("item_id", *text("latest_date"), "latest_value", *text("base_date"), "base_value")


# Matching stated as a plain join of every text with every term.
_NORM = "regexp_replace(lower({}), '[\\s\\x{{3000}}・･\\-_()\\[\\]【】「」『』]', '', 'g')"


def _norm(x: str) -> str:
    return _NORM.format(x)


_SAFE = "(length(n) >= 4 AND (NOT regexp_full_match(n, '[a-z0-9]+') OR length(n) >= 6))"
_SAFE_TOKEN = "(length(n) >= 3 AND (NOT regexp_full_match(n, '[a-z0-9]+') OR length(n) >= 5))"
TERMS_SQL = f"""terms AS (SELECT *, {_norm('term')} AS n FROM (
        SELECT catalog_id, 'name' AS role, 0 AS pos, name AS term FROM phrases
        UNION ALL SELECT catalog_id, 'alias', 0, short_name FROM phrases
        UNION ALL SELECT catalog_id, 'alias', generate_subscripts(aliases, 1), unnest(aliases) FROM phrases
        UNION ALL SELECT catalog_id, 'ambiguous', generate_subscripts(ambiguous_aliases, 1), unnest(ambiguous_aliases) FROM phrases
        UNION ALL SELECT DISTINCT catalog_id, 'weak', 0, unnest(regexp_split_to_array(t, '[\\s・･\\-_()\\[\\]【】「」『』]+'))
            FROM (SELECT catalog_id, unnest(list_concat([name, short_name], aliases, ambiguous_aliases)) AS t FROM phrases))
        WHERE term <> ''),
    usable AS (SELECT *, role IN ('name', 'alias') AND {_SAFE} AS confirms FROM terms
        WHERE n <> '' AND (role = 'name' OR (role = 'weak' AND {_SAFE_TOKEN}) OR (role IN ('alias', 'ambiguous') AND {_SAFE}))),
    guards AS (SELECT catalog_id, list_transform(coalesce(exclude_terms, []), lambda x: {_norm('x')}) AS exclusions,
        list_transform(resolving_keywords, lambda x: {_norm('x')}) AS resolvers FROM phrases),
    hits AS (SELECT t.item_id, u.catalog_id, u.role, u.pos, u.term, u.n, u.confirms,
        len(list_filter(g.resolvers, lambda x: contains(t.title_text, x))) > 0 AS resolved
        FROM titles t JOIN usable u ON contains(t.title_text, u.n) JOIN guards g ON g.catalog_id = u.catalog_id
        WHERE len(list_filter(g.exclusions, lambda x: contains(t.title_text, x))) = 0),
    best AS (SELECT item_id, catalog_id, bool_or(role = 'weak') AND NOT bool_or(confirms) AS is_ambiguous,
        CASE WHEN bool_or(role = 'name') THEN 'exact_name' WHEN bool_or(role = 'alias') OR (bool_or(role = 'ambiguous') AND bool_or(resolved))
        THEN 'alias' END AS method,
        CASE WHEN bool_or(role = 'name') THEN 100 WHEN bool_or(role = 'alias') THEN 85
        WHEN bool_or(role = 'ambiguous') AND bool_or(resolved) THEN 75 END AS confidence,
        CASE WHEN bool_or(role = 'name') THEN arg_min(term, pos) FILTER (role = 'name')
        WHEN bool_or(role = 'alias') THEN arg_min(term, row(-length(term), pos)) FILTER (role = 'alias')
        WHEN bool_or(role = 'ambiguous') AND bool_or(resolved) THEN arg_min(term, pos) FILTER (role = 'ambiguous') END AS term
        FROM hits GROUP BY ALL),
    judged AS (SELECT b.*, b.method IS NOT NULL AND NOT EXISTS (SELECT 1 FROM best o WHERE o.item_id = b.item_id
        AND o.catalog_id <> b.catalog_id AND o.method IS NOT NULL AND length({_norm('o.term')}) > length({_norm('b.term')})
        AND contains({_norm('o.term')}, {_norm('b.term')})) AS is_match FROM best b)"""


@query(
    "j11_title_matches",
    f"WITH {TERMS_SQL} SELECT item_id, catalog_id, method, CAST(confidence AS BIGINT) AS confidence, term FROM judged WHERE is_match",
)
def _(v: Views) -> DataFrame:
    return match_titles(v.titles(), v.phrases()).select("item_id", "catalog_id", "method", *whole("confidence"), "term")


@query("j12_ambiguous_candidates", f"WITH {TERMS_SQL} SELECT item_id, catalog_id FROM judged WHERE is_ambiguous")
def _(v: Views) -> DataFrame:
    return ambiguous_candidates(v.titles(), v.phrases())


@query(
    "j13_contained_matches",
    f"WITH {TERMS_SQL} SELECT item_id, catalog_id, term FROM judged WHERE method IS NOT NULL AND NOT is_match",
)
def _(v: Views) -> DataFrame:
    index = index_catalog(v.phrases(), MATCHING_ROLES)
    rows = judged_pairs(title_hits(v.titles(), index), index)
    return rows.where("method IS NOT NULL AND NOT is_match").select("item_id", "catalog_id", "term")


def identity_sql(name: str, maker: str, kind: str, date: str) -> str:
    """Identity key for plain ASCII names, to which the numeral rules apply in the same order."""
    n = f"lower({name})"
    for numeral, digit in (("vi", 6), ("iv", 4), ("iii", 3), ("ii", 2), ("i", 1)):
        n = f"regexp_replace({n}, '(^|[^a-z]){numeral}([^a-z]|$)', '\\1{digit}\\2', 'g')"
    n = f"regexp_replace({n}, '[\\s・,，.．:：/／\\-_()（）「」『』]', '', 'g')"
    m = f"regexp_replace(lower({maker}), '[\\s・.．]', '', 'g')"
    return f"{n} || '|' || coalesce({m}, '') || '|' || coalesce({kind}, '') || '|' || coalesce(CAST({date} AS VARCHAR), '')"


_KEY = identity_sql("name", "maker", "kind", "release_date")


@query(
    "j14_by_name_or_key",
    f"""WITH k AS (SELECT catalog_id, name, {_KEY} AS key FROM kinds)
    SELECT s.catalog_id AS seed_id, min(e.catalog_id) AS existing_id FROM (SELECT catalog_id, name, key FROM k WHERE catalog_id >= 50) s
    JOIN (SELECT * FROM k WHERE catalog_id < 50) e ON e.name = s.name OR e.key = s.key GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    keyed = with_identity_key(v.catalog())
    seeds = keyed.where("catalog_id >= 50").withColumnRenamed("catalog_id", "seed_id")
    return L.by_name_or_key(seeds, keyed.where("catalog_id < 50"), "seed_id")


@query(
    "j15_by_id_else_handle",
    """SELECT position, coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.entity_id IS NOT NULL THEN 'id'
    WHEN b.entity_id IS NOT NULL THEN 'handle' END AS found_by
    FROM (SELECT s_suppkey AS position, 'ext' || (s_suppkey * 7) AS external_id, '@h' || (s_suppkey * 5) AS handle FROM supplier) s
    LEFT JOIN entities a ON a.external_id = s.external_id LEFT JOIN entities b ON b.handle = s.handle""",
)
def _(v: Views) -> DataFrame:
    seeds = v.table("supplier").selectExpr(
        "s_suppkey AS position", "concat('ext', s_suppkey * 7) AS external_id", "concat('@h', s_suppkey * 5) AS handle"
    )
    return L.by_id_else_handle(seeds, v.entities()).select("position", "entity_id", "found_by")


@query(
    "j16_conflicts",
    """SELECT link_id, l.item_id, l.catalog_id FROM links l JOIN merge_groups ON catalog_id = duplicate_id
    WHERE EXISTS (SELECT 1 FROM links c WHERE c.item_id = l.item_id AND c.catalog_id = canonical_id)""",
)
def _(v: Views) -> DataFrame:
    groups = merge_groups(v)
    moved = S.rekey(v.links(), groups)
    canonical = moved.where(~F.col("was_duplicate")).select("item_id", "catalog_id")
    duplicate = v.links().join(groups, F.col("catalog_id") == F.col("duplicate_id"))
    pairs = duplicate.withColumn("pair", F.struct("item_id", F.col("canonical_id").alias("catalog_id")))
    held = canonical.select(F.struct("item_id", "catalog_id").alias("pair"))
    return L.conflicts(pairs, held, "pair").select("link_id", "item_id", "catalog_id")


@query("j17_matching_entries", f"WITH {TERMS_SQL} SELECT DISTINCT catalog_id FROM judged WHERE is_match")
def _(v: Views) -> DataFrame:
    return matching_entries(v.titles(), v.phrases()).select("catalog_id")


def merge_groups(v: Views) -> DataFrame:
    """Entries of equal name and maker: the smallest id is canonical, the others its duplicates."""
    first = v.catalog().groupBy("name", "maker").agg(F.min("catalog_id").alias("canonical_id"))
    return v.catalog().join(first, ["name", "maker"]).where("canonical_id <> catalog_id").select(
        "canonical_id", F.col("catalog_id").alias("duplicate_id")
    )


# -- set operations --------------------------------------------------------


@query(
    "u1_union_strings",
    """SELECT catalog_id, array_to_string(list_concat(aliases, list_filter(coalesce(unique_aliases, []),
    lambda x: NOT list_contains(aliases, x)), list_filter(resolving_keywords, lambda x: NOT list_contains(aliases, x)
    AND NOT list_contains(coalesce(unique_aliases, []), x))), '|') AS terms FROM catalog""",
)
def _(v: Views) -> DataFrame:
    union = S.union_strings(F.col("aliases"), F.col("unique_aliases"), F.col("resolving_keywords"))
    return v.catalog().select("catalog_id", F.array_join(union, "|").alias("terms"))


@query(
    "u2_shared_items",
    """WITH chosen AS (SELECT DISTINCT catalog_id FROM links WHERE item_id = (SELECT item_id FROM links GROUP BY item_id
        HAVING count(DISTINCT catalog_id) > 1 ORDER BY item_id LIMIT 1) ORDER BY catalog_id LIMIT 2)
    SELECT item_id FROM links WHERE catalog_id IN (SELECT catalog_id FROM chosen) GROUP BY item_id HAVING count(DISTINCT catalog_id) = 2""",
)
def _(v: Views) -> DataFrame:
    """Items of two entries that share some: the first two of the first item that has several."""
    several = v.links().groupBy("item_id").agg(F.count_distinct("catalog_id").alias("n")).where("n > 1").orderBy("item_id").limit(1)
    chosen = v.links().join(several, "item_id", "left_semi").select("catalog_id").distinct().orderBy("catalog_id").limit(2)
    return S.shared_items(v.links(), [r.catalog_id for r in chosen.collect()])


@query(
    "u3_added_aliases",
    """SELECT catalog_id, array_to_string(list_filter([name, p_type], lambda x: NOT list_contains(aliases, x)), '|') AS added
    FROM catalog JOIN part ON p_partkey = catalog_id""",
)
def _(v: Views) -> DataFrame:
    rows = v.catalog()
    after = S.union_strings(F.array("name"), F.array(F.col("aliases")[0]))
    return rows.select("catalog_id", F.array_join(S.added_strings(after, F.col("aliases")), "|").alias("added"))


@query(
    "u4_last_per_name",
    """SELECT name, arg_max(catalog_id, row(source, catalog_id)) AS position FROM (SELECT name, catalog_id,
    CASE WHEN type = 'slot' THEN 1 ELSE 0 END AS source FROM catalog) GROUP BY name""",
)
def _(v: Views) -> DataFrame:
    seeds = v.catalog().withColumnRenamed("catalog_id", "position")
    older = seeds.where("type IS NULL OR type <> 'slot'").select("name", "position")
    return S.last_per_name(older, seeds.where("type = 'slot'").select("name", "position"))


@query(
    "u5_merged_and_removed",
    """SELECT link_id, item_id, catalog_id, link_id <> min(link_id) OVER (PARTITION BY item_id, catalog_id) AS removed FROM (
    SELECT link_id, item_id, coalesce(canonical_id, catalog_id) AS catalog_id FROM links LEFT JOIN merge_groups
    ON catalog_id = duplicate_id)""",
)
def _(v: Views) -> DataFrame:
    rows = S.merged_and_removed(v.links(), merge_groups(v), "item_id", "link_id")
    return rows.select("link_id", "item_id", "catalog_id", "removed")


@query(
    "u6_differing_ids",
    """SELECT catalog_id, 'unexpected' AS side FROM (SELECT catalog_id FROM links EXCEPT ALL SELECT catalog_id FROM judgments)
    UNION ALL SELECT catalog_id, 'missing' FROM (SELECT catalog_id FROM judgments EXCEPT ALL SELECT catalog_id FROM links)""",
)
def _(v: Views) -> DataFrame:
    return S.differing_ids(v.links(), v.judgments(), "catalog_id")


@query(
    "w9_preferred_links",
    """SELECT item_id, catalog_id, method, link_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id, catalog_id ORDER BY
    CASE method WHEN 'manual_excluded' THEN 0 ELSE 1 END, CASE method WHEN 'manual' THEN 0 WHEN 'exact_name' THEN 1 ELSE 2 END,
    CASE WHEN method = 'manual_excluded' THEN 0 ELSE -confidence END, link_id) AS rn FROM (SELECT l.* EXCLUDE (catalog_id),
    coalesce(canonical_id, catalog_id) AS catalog_id FROM links l LEFT JOIN merge_groups ON catalog_id = duplicate_id)) WHERE rn = 1""",
)
def _(v: Views) -> DataFrame:
    rows = L.preferred_links(S.rekey(v.links(), merge_groups(v)))
    return rows.select("item_id", "catalog_id", "method", "link_id")


@query(
    "w10_newest_mentions",
    """SELECT item_id, catalog_id, mention_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id, catalog_id
    ORDER BY updated_at DESC, mention_id) AS rn FROM (SELECT item_id, coalesce(canonical_id, catalog_id) AS catalog_id,
    link_id AS mention_id, updated_at FROM links LEFT JOIN merge_groups ON catalog_id = duplicate_id)) WHERE rn = 1""",
)
def _(v: Views) -> DataFrame:
    mentions = S.rekey(v.links(), merge_groups(v)).withColumnRenamed("link_id", "mention_id")
    return L.newest_mentions(mentions).select("item_id", "catalog_id", "mention_id")


@query(
    "w10_first_votes",
    "SELECT target_id, voter_id, min(vote_id) AS vote_id, arg_min(vote_type, vote_id) AS vote_type FROM votes GROUP BY ALL",
)
def _(v: Views) -> DataFrame:
    return L.first_votes(v.votes()).select("target_id", "voter_id", "vote_id", "vote_type")


@query(
    "a3_catalog_stats",
    """SELECT catalog_id, count(*) AS item_count, count(DISTINCT entity_id) AS entity_count, CAST(sum(view_count) AS BIGINT) AS total_views,
    CAST(sum(CASE WHEN is_ready THEN greatest(0, delta) ELSE 0 END) AS BIGINT) AS recent_views,
    count(*) FILTER (is_ready) AS recent_item_count FROM rankable LEFT JOIN item_trend_7 USING (item_id) GROUP BY catalog_id""",
)
def _(v: Views) -> DataFrame:
    slim = v.items().select("item_id", "entity_id", "view_count", "content_type", "match_status")
    return catalog_stats(L.confirmed_pairs(v.links(), slim, rankable=True), item_trends(v.item_daily(), 7))
