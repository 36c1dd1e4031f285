"""Composite jobs on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from risemeter.operators import links as L, predicates as P, ranking as T, tallies as A
from risemeter.plans import catalog as C, digest as D, discovery, ingest, items as I, merge as M, review as R, seeding, votes as V
from risemeter.sources import payloads, seeds, sinks, tables

VOTE = "vote_id BIGINT, target_id BIGINT, voter_id STRING, vote_type STRING, created_at TIMESTAMP"


def at(minute):
    return dt.datetime(2026, 7, 1, 12, minute)


# -- votes -----------------------------------------------------------------


def test_votes(spark, rows):
    cast = [
        (1, 1, "voter-001", "want_to_play", at(1)), (2, 1, "voter-001", "want_to_play", at(2)),
        (3, 1, "voter-001", "not_interested", at(3)), (4, 1, "voter-002", "want_to_play", at(1)),
        (5, 1, "short", "want_to_play", at(1)), (6, 1, "voter-003", "maybe", at(1)), (7, 9, "voter-001", "want_to_play", at(1)),
    ]
    votes = spark.createDataFrame(cast, VOTE)
    targets = spark.createDataFrame([(1,)], "target_id BIGINT")
    valid = V.accepted_votes(votes, targets)
    assert rows(V.vote_outcomes(valid), "vote_id", "outcome") == [
        (1, "recorded"), (2, "already_recorded"), (3, "updated"), (4, "recorded")
    ]
    current = V.vote_upsert(valid.where("vote_id < 3"), valid.where("vote_id >= 3"))
    assert rows(current, "voter_id", "vote_type") == [("voter-001", "not_interested"), ("voter-002", "want_to_play")]
    tally = V.vote_counts(current).first().asDict()
    assert (tally["want_to_play"], tally["wait_and_see"], tally["not_interested"], tally["total"]) == (1, 0, 1, 2)
    assert tally["want_to_play_share"] == 50
    audit = V.vote_audit(valid).collect()
    assert [(r.voter_id, r.vote_id, r.duplicate_count, r.kept_id) for r in audit] == [("voter-001", i, 3, 3) for i in (1, 2, 3)]


def test_one_vote_row_per_pair_in_any_order(spark, rows):
    cast = [(i, 1, "voter-001", k, at(i)) for i, k in enumerate(["want_to_play", "wait_and_see", "not_interested"])]
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        votes = spark.createDataFrame([cast[i] for i in order], VOTE)
        assert rows(sinks.latest_votes(votes), "vote_type") == [("not_interested",)]


# -- orders and parameters ---------------------------------------------------


def test_pages(spark):
    ranked = spark.createDataFrame(
        [("c", 1000, 10), ("a", 1000, 10), ("b", 900, 10), ("d", 2000, 5)], "item_id STRING, view_count BIGINT, delta BIGINT"
    )
    first = T.page_after(ranked, 2).orderBy(*T.trending_order()).collect()
    assert [(r.item_id, r.has_next) for r in first] == [("a", True), ("c", True)]
    second = T.page_after(ranked, 2, (10, 1000, "c")).orderBy(*T.trending_order()).collect()
    assert [(r.item_id, r.has_next) for r in second] == [("b", False), ("d", False)]
    missing = T.page_after(ranked, 2, (10, 950, "missing")).orderBy(*T.trending_order()).collect()
    assert [r.item_id for r in missing] == ["b", "d"]


def test_parameters():
    assert [T.clamp_limit(x, 50, 100) for x in (None, "20", "0", "-3", "2.5", "x", "500")] == [50, 20, 50, 50, 50, 50, 100]
    assert [T.offset_from(x) for x in (None, "20", "-1", "1.5", "x")] == [0, 20, 0, 0, 0]
    assert [P.period_from(x) for x in (None, "1", 30, "14", "x")] == [7, 1, 30, 7, 7]
    assert [P.period_of_mode(x) for x in (None, "7d", "previous", "x")] == [1, 7, 1, 1]
    assert P.content_types_from("short, live ,clips") == ["short", "live"]
    assert P.content_types_from("clips") == P.content_types_from(None) == ["standard"]


def test_positions_over_partitions(spark):
    ranked = spark.range(0, 1000, 1, 7).select(F.col("id").alias("catalog_id"), (F.col("id") % 10).alias("recent_views"), F.lit(0).alias("total_views"))
    got = T.with_positions(ranked, T.momentum_order()).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 1001))
    expected = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert [r.catalog_id for r in got] == expected


def test_locale_order(spark):
    names = spark.createDataFrame([("B", 1), ("a", 2), ("い", 3), ("ア", 4)], "name STRING, entity_id INT")
    assert [r.name for r in names.orderBy(T.by_name()).collect()] == ["a", "B", "ア", "い"]


# -- buzz ------------------------------------------------------------------


def buzz_tables(spark):
    catalog = spark.createDataFrame(
        [(1, "A", "m", "pachinko"), (2, "B", "m", "スロット"), (3, "Zero", None, "odd")], "catalog_id BIGINT, name STRING, maker STRING, type STRING"
    ).withColumn("release_date", F.lit("2026-07-01").cast("date"))
    items = spark.createDataFrame(
        [
            ("v1", 1, 170, "standard", "matched"), ("v2", 1, 200, "short", "matched"), ("v3", 2, 999, "promotion", "matched"),
            ("v4", 2, 500, "standard", "manual"),
        ],
        "item_id STRING, entity_id BIGINT, view_count BIGINT, content_type STRING, match_status STRING",
    )
    links = spark.createDataFrame(
        [
            (1, "v1", 1, "exact_name"), (2, "v1", 1, "alias"), (3, "v2", 1, "manual"), (4, "v3", 1, "alias"), (5, "v2", 2, "manual_excluded"),
            (6, "v4", 2, "manual"),
        ],
        "link_id BIGINT, item_id STRING, catalog_id BIGINT, method STRING",
    )
    days = [("v1", "2026-07-17", 170), ("v1", "2026-07-10", 100), ("v2", "2026-07-17", 200), ("v2", "2026-07-10", 250)]
    daily = spark.createDataFrame(days, "item_id STRING, d STRING, view_count BIGINT").selectExpr(
        "item_id", "CAST(d AS DATE) AS date", "view_count"
    )
    return catalog, links, items, daily


def test_buzz(spark):
    got = {r.catalog_id: r for r in C.catalog_buzz(*buzz_tables(spark)).collect()}
    a = got[1]
    assert (a.item_count, a.entity_count, a.total_views, a.recent_views, a.recent_item_count) == (2, 1, 370, 70, 2)
    for zero in (got[2], got[3]):
        assert (zero.item_count, zero.entity_count, zero.total_views, zero.recent_views) == (0, 0, 0, 0)
    assert [got[i].type for i in (1, 2, 3)] == ["pachinko", "slot", None]


# -- merging -----------------------------------------------------------------


def merge_tables(spark):
    catalog = spark.createDataFrame(
        [
            (8, "Foo II", "M.", "slot", dt.date(2026, 7, 21), "Foo", None, ["a", "b"]),
            (5, "foo 2", "m", "スロット", dt.date(2026, 7, 21), None, "S", ["b", "c"]),
            (9, "Other", "m", "slot", dt.date(2026, 7, 21), None, None, None),
        ],
        "catalog_id BIGINT, name STRING, maker STRING, type STRING, release_date DATE, short_name STRING, series STRING, aliases ARRAY<STRING>",
    )
    for c in M.SCALARS + M.LISTS:
        if c not in catalog.columns:
            catalog = catalog.withColumn(c, F.lit(None).cast("array<string>" if c in M.LISTS else "string"))
    links = spark.createDataFrame(
        [
            (1, "v1", 8, "exact_name", 100), (2, "v1", 5, "manual_excluded", 0), (3, "v2", 5, "alias", 85), (4, "v3", 9, "alias", 85),
            (5, "v4", 8, "alias", 85), (6, "v4", 5, "exact_name", 100),
        ],
        "link_id BIGINT, item_id STRING, catalog_id BIGINT, method STRING, confidence INT",
    )
    mentions = spark.createDataFrame(
        [(1, "v1", 8, at(1)), (2, "v1", 5, at(2)), (3, "v2", 5, at(1))], "mention_id BIGINT, item_id STRING, catalog_id BIGINT, updated_at TIMESTAMP"
    )
    votes = spark.createDataFrame(
        [(1, 5, "voter-001", "want_to_play", at(1)), (2, 8, "voter-001", "wait_and_see", at(2)), (3, 5, "voter-002", "wait_and_see", at(1))], VOTE
    )
    judgments = spark.createDataFrame([(1, "k1", 5), (2, "k2", 9)], "judgment_id BIGINT, judgment_key STRING, catalog_id BIGINT")
    groups = spark.createDataFrame([(8, 5)], "canonical_id BIGINT, duplicate_id BIGINT")
    return catalog, links, mentions, votes, judgments, groups


def test_merge(spark, rows, folder):
    catalog, links, mentions, votes, judgments, groups = merge_tables(spark)
    assert rows(M.validate_groups(groups, catalog), "ok", "reason") == [(True, "same normalized machine identity")]
    merged = M.merge_catalog(catalog, links, mentions, votes, judgments, groups)
    stored = sinks.write_verified(spark, merged.tables(), f"{folder}/new", lambda t: M.merge_problems(t, groups))
    assert rows(stored["catalog"], "catalog_id", "short_name", "series", "aliases") == [
        (8, "Foo", "S", ["a", "b", "c"]), (9, None, None, None)
    ]
    assert rows(stored["links"], "item_id", "catalog_id", "method") == [
        ("v1", 8, "manual_excluded"), ("v2", 8, "alias"), ("v3", 9, "alias"), ("v4", 8, "exact_name")
    ]
    assert rows(stored["mentions"], "mention_id", "catalog_id") == [(2, 8), (3, 8)]
    assert rows(stored["votes"], "vote_id", "target_id") == [(1, 8), (3, 8)]
    assert rows(stored["judgments"], "judgment_id", "catalog_id") == [(1, 8), (2, 9)]
    # Merging the result again changes nothing.
    again = M.merge_catalog(stored["catalog"], stored["links"], stored["mentions"], stored["votes"], stored["judgments"], groups)
    for name, table in again.tables().items():
        assert rows(table.select(*sorted(table.columns))) == rows(stored[name].select(*sorted(table.columns)))
    assert rows(M.validate_groups(groups, stored["catalog"]), "ok", "reason") == [(True, "already merged")]


def test_failed_merge_leaves_the_tables(spark, rows, folder):
    catalog, links, mentions, votes, judgments, groups = merge_tables(spark)
    links.write.parquet(f"{folder}/old")
    before = spark.read.parquet(f"{folder}/old")
    merged = M.merge_catalog(catalog, before, mentions, votes, judgments, groups).tables()
    merged["links"] = before  # still points at the removed id
    with pytest.raises(ValueError, match="fail their check"):
        sinks.write_verified(spark, merged, f"{folder}/new", lambda t: M.merge_problems(t, groups))
    assert rows(spark.read.parquet(f"{folder}/old")) == rows(links)


def test_several_duplicates_fold_in_order(spark, rows):
    catalog, *_ = merge_tables(spark)
    groups = spark.createDataFrame([(9, 5), (9, 8)], "canonical_id BIGINT, duplicate_id BIGINT")
    assert rows(M.folded_catalog(catalog, groups), "catalog_id", "short_name", "series", "aliases") == [(9, "Foo", "S", ["b", "c", "a"])]


def test_groups_that_must_not_merge(spark, rows):
    catalog, *_ = merge_tables(spark)
    groups = spark.createDataFrame([(8, 9), (8, 77), (77, 8)], "canonical_id BIGINT, duplicate_id BIGINT")
    got = rows(M.validate_groups(groups, catalog), "canonical_id", "duplicate_id", "ok", "reason")
    assert got == [
        (77, 8, False, "machine row missing"), (8, 77, True, "already merged"), (8, 9, False, "machine identity differs")
    ]


# -- review --------------------------------------------------------------------


def test_overrides(spark, rows):
    items = spark.createDataFrame([("v1", "matched"), ("v2", "matched"), ("v3", "unmatched")], "item_id STRING, match_status STRING")
    links = spark.createDataFrame([("v1", 1, "alias", 85), ("v2", 1, "alias", 85)], "item_id STRING, catalog_id BIGINT, method STRING, confidence INT")
    catalog = spark.createDataFrame([(1,), (2,)], "catalog_id BIGINT")
    overrides = spark.createDataFrame(
        [("v1", 1, "exclude", 1), ("v1", 2, "link", 2), ("v2", 1, "link", 3), ("v2", 1, "exclude", 4), ("v9", 1, "link", 5), ("v3", 7, "link", 6)],
        "item_id STRING, catalog_id BIGINT, kind STRING, position INT",
    )
    done = R.apply_overrides(items, links, catalog, overrides)
    assert rows(done.links, "item_id", "catalog_id", "method", "confidence") == [
        ("v1", 1, "manual_excluded", 0), ("v1", 2, "manual", 100), ("v2", 1, "manual_excluded", 0)
    ]
    assert rows(done.items) == [("v1", "manual"), ("v2", "manual_excluded"), ("v3", "unmatched")]


def test_judgments_need_the_same_entry_and_an_open_item(spark, rows):
    sent = spark.createDataFrame(
        [(1, 0, "v1", 7), (1, 1, "v2", 7), (1, 2, "v3", 7), (1, 3, "v4", 7), (1, 4, "v5", 7)],
        "batch_id INT, candidate_index BIGINT, item_id STRING, catalog_id BIGINT",
    )
    answer = [
        {"candidateIndex": i, "machineId": m, "confidence": c}
        for i, m, c in ((0, 7, 0.95), (1, 8, 0.95), (2, 7, 0.8), (3, 7, 0.99))
    ]
    responses = spark.createDataFrame([(1, "text " + json.dumps(answer))], "batch_id INT, response_text STRING")
    items = spark.createDataFrame([(f"v{i}", "manual" if i == 4 else "unmatched") for i in range(1, 6)], "item_id STRING, match_status STRING")
    links = spark.createDataFrame([], "item_id STRING, catalog_id BIGINT")
    done = R.apply_judgments(sent, responses, items, links)
    assert rows(done.new_links) == [("v1", 7, "alias", 90)]
    assert tuple(done.summary.first()) == (5, 2, 1, 1, 1)


def test_review_jobs_write_mentions_and_error_judgments(spark, rows):
    columns = "item_id STRING, entity_id BIGINT, title STRING, match_status STRING, view_count BIGINT, like_count BIGINT, comment_count BIGINT, published_at STRING"
    items = spark.createDataFrame([(f"v{i}", i, f"t{i}", "manual" if i == 3 else "unmatched", 10 * i, i, 0, "2024-01-01") for i in range(1, 5)], columns)
    links = spark.createDataFrame([("v2", 7, "alias", 85)], "item_id STRING, catalog_id BIGINT, method STRING, confidence INT")
    shown = ("item_id", "catalog_id", "entity_id", "title", "view_count")

    sent = [(1, k, f"v{k + 1}", 7) for k in range(3)] + [(b, k, f"v{k + 1}", 8) for b in (2, 3, 4, 5) for k in range(2)]
    answer = json.dumps([{"candidateIndex": k, "machineId": 7, "confidence": 0.95} for k in range(3)])
    responses = [(1, answer, None), (2, "sorry", None), (3, '[{"candidateIndex": 0', None), (4, "[]", None), (3, None, "503 unavailable"), (6, "[", "x")]
    done = R.apply_judgments(
        spark.createDataFrame(sent, "batch_id INT, candidate_index BIGINT, item_id STRING, catalog_id BIGINT"),
        spark.createDataFrame(responses, "batch_id INT, response_text STRING, error STRING"), items, links,
    )
    assert rows(done.mentions, *shown) == [("v1", 7, 1, "t1", 10), ("v2", 7, 2, "t2", 20)]
    errors = rows(done.error_judgments, "batch_id", "item_id", "judgment_key", "status", "confidence", "reason")
    assert [e[:2] for e in errors] == [(2, "v1"), (2, "v2"), (3, "v1"), (3, "v2")]
    assert errors[0][2:] == ("v1:gemini:v1:8", "error", 0, "missing JSON array")
    assert done.judgments.unionByName(done.error_judgments).count() == 7

    judgments = spark.createDataFrame(
        [(1, "v2", 7, 5, "pending", 80), (2, "v4", 7, 9, "pending", 70), (3, "v4", 7, 4, "pending", 75), (4, "v8", 7, 6, "pending", 70), (5, "v1", 7, None, "pending", 70)],
        "judgment_id INT, item_id STRING, catalog_id BIGINT, entity_id BIGINT, status STRING, confidence INT",
    )
    decisions = judgments.selectExpr("judgment_id", "'approve' AS decision")
    assert rows(R.apply_reviews(judgments, decisions, links, items).mentions, *shown) == [
        ("v2", 7, 5, "t2", 20), ("v4", 7, 9, "t4", 40), ("v8", 7, 6, None, 0)
    ]

    overrides = spark.createDataFrame([("v1", 7, "link", 1), ("v3", 7, "exclude", 2)], "item_id STRING, catalog_id BIGINT, kind STRING, position INT")
    catalog = spark.createDataFrame([(7,)], "catalog_id BIGINT")
    done = R.apply_overrides(items, links, catalog, overrides)
    assert rows(done.mentions, *shown) == [("v1", 7, 1, "t1", 10)] and rows(done.touched) == [("v1",), ("v3",)]


# -- digest --------------------------------------------------------------------


def test_digest_without_data(spark):
    entities = spark.createDataFrame([(1, "a", True)], "entity_id BIGINT, name STRING, active BOOLEAN")
    daily = spark.createDataFrame([], "entity_id BIGINT, date DATE, subscriber_count BIGINT")
    catalog = spark.createDataFrame([(1, "x", None)], "catalog_id BIGINT, name STRING, maker STRING")
    mentions = spark.createDataFrame([], "catalog_id BIGINT, item_id STRING, view_count BIGINT")
    row = D.weekly_digest(D.digest_tops(entities, daily, catalog, mentions), "2026-07-13").first()
    assert row.body_markdown.count(D.NO_GROWTH) == 2 and row.body_markdown.endswith(D.NO_BUZZ)


def test_digest_lines(spark):
    entities = spark.createDataFrame([(1, "a", True), (2, "b", True)], "entity_id BIGINT, name STRING, active BOOLEAN")
    days = [(1, dt.date(2026, 7, 1), 1000), (1, dt.date(2026, 7, 9), 2500), (2, dt.date(2026, 7, 1), 900), (2, dt.date(2026, 7, 9), 800)]
    daily = spark.createDataFrame(days, "entity_id BIGINT, date DATE, subscriber_count BIGINT")
    catalog = spark.createDataFrame([(1, "x", None)], "catalog_id BIGINT, name STRING, maker STRING")
    mentions = spark.createDataFrame([(1, "v", 12345)], "catalog_id BIGINT, item_id STRING, view_count BIGINT")
    body = D.weekly_digest(D.digest_tops(entities, daily, catalog, mentions), "2026-07-13").first().body_markdown
    lines = body.split("\n")
    assert lines[0].startswith("# 2026-07-13") and lines[4] == D.HEADINGS["rising"]
    assert lines[6:8] == ["1. **a** — 現在2,500人 (+1,500)", "2. **b** — 現在800人 (-100)"]
    assert lines[11:13] == ["1. **b** — 現在800人 (-100)", "2. **a** — 現在2,500人 (1,500)"]
    assert lines[-1] == "1. **x**(メーカー不明) — 合計再生数12,345・関連動画1本"


# -- discovery -------------------------------------------------------------------


def test_discovery(spark):
    hits = [
        ("q1", "v1", "c1", "T1", "2026-07-20T00:00:00Z"), ("q2", "v1", "c1", "T1", "2026-07-20T00:00:00Z"), ("q1", "v2", "c1", "T1", "2026-07-10T00:00:00Z"),
        ("q1", "v3", "c2", "T2", "2026-07-01T00:00:00Z"), ("q1", "v4", "c3", "T3", "2026-07-01T00:00:00Z"), ("q1", "v5", "c3", "T3", "2026-07-02T00:00:00Z"),
        ("q1", "v6", "known", "K", "2026-07-01T00:00:00Z"), ("q1", "v7", "known", "K", "2026-07-01T00:00:00Z"),
    ]
    frame = spark.createDataFrame(hits, "query STRING, item_id STRING, external_id STRING, entity_title STRING, published_at STRING")
    frame = frame.withColumn("title", F.lit("t"))
    details = spark.createDataFrame([("c1", "One", None, 5, 6)], "external_id STRING, title STRING, subscriber_count BIGINT, view_count BIGINT, video_count BIGINT")
    registered = spark.createDataFrame([("known",)], "external_id STRING")
    now = F.lit("2026-07-21 00:00:00").cast("timestamp")
    got = discovery.discover_candidates(frame, details, registered, now, 2, 10).collect()
    assert [(r.external_id, r.title, r.item_count, r.queries, r.score) for r in got] == [
        ("c1", "One", 2, ["q1", "q2"], round(40 + 30 + 20 - 1 / 3, 3)),
        ("c3", "T3", 2, ["q1"], round(40 + 15 + 20 - 19 / 3, 3)),
    ]
    assert discovery.sample_items(frame, 1).where("external_id = 'c1'").first().item_id == "v1"


# -- payloads and seeds ------------------------------------------------------------


def test_payload_files(spark, folder):
    thumbs = {"medium": {"url": "m"}, "default": {"url": "d"}}
    answers = [
        {"items": [{"id": "c1", "snippet": {"title": "A", "thumbnails": thumbs}, "statistics": {"subscriberCount": "10", "hiddenSubscriberCount": True}}]},
        {"items": [{"id": "c2"}]},
        {"kind": "empty"},
    ]
    with open(f"{folder}/p.json", "w", encoding="utf8") as out:
        out.write("\n".join(json.dumps(a) for a in answers))
    rows = payloads.read_payloads(spark, folder, payloads.ENTITY_ITEM)
    stats = {r.external_id: r for r in payloads.entity_stats(rows).collect()}
    assert (stats["c1"].thumbnail_url, stats["c1"].subscriber_count, stats["c2"].name, stats["c2"].view_count) == ("m", 10, "Unknown", 0)
    details = {r.external_id: r for r in payloads.entity_details(rows).collect()}
    assert details["c1"].subscriber_count is None and details["c2"].description == ""


def test_seed_and_alias_files(spark, folder, rows):
    with open(f"{folder}/alias.json", "w", encoding="utf8") as out:
        json.dump({"suggestions": [{"machineId": 1, "shortName": "s", "aliases": ["x"], "excludeTerms": [], "approved": True}, {"machineId": 2}]}, out, indent=1)
    approved = seeds.approved_aliases(seeds.read_alias_file(spark, f"{folder}/alias.json"))
    assert rows(approved, "catalog_id", "short_name", "aliases") == [(1, "s", ["x"])]
    with open(f"{folder}/seeds.json", "w", encoding="utf8") as out:
        out.write('{"name": "A", "type": "slot"}\n{"name": "B"}\n')
    assert rows(seeds.read_seeds(spark, f"{folder}/seeds.json", seeds.CATALOG_SEED), "name", "type", "position") == [("A", "slot", 0), ("B", None, 1)]


SEED = "name STRING, maker STRING, type STRING, release_date DATE, aliases ARRAY<STRING>, position BIGINT"


def test_catalog_upsert(spark, rows):
    day = dt.date(2026, 7, 1)
    catalog = spark.createDataFrame([(1, "Foo 2", "M", "slot", day, ["old"])], "catalog_id BIGINT, name STRING, maker STRING, type STRING, release_date DATE, aliases ARRAY<STRING>")
    older = spark.createDataFrame([("New", "old maker", "slot", day, None, 0)], SEED)
    newer = spark.createDataFrame(
        [("foo II", "M.", "パチスロ", day, None, 0), ("New", "N", "slot", day, ["n"], 1), ("NEW", "N", "slot", day, ["m"], 2)], SEED
    )
    plan = seeding.plan_catalog_upsert(catalog, older, newer)
    assert rows(plan, "name", "action", "existing_id") == [("NEW", "update", None), ("New", "insert", None), ("foo II", "update", 1)]
    assert tuple(seeding.upsert_counts(plan).first()) == (1, 2)
    done = seeding.apply_catalog_upsert(catalog, plan)
    assert rows(done, "catalog_id", "name", "maker", "aliases") == [(1, "foo II", "M.", ["old"]), (None, "NEW", "N", ["m"])]


def test_entity_upsert(spark, rows):
    entities = spark.createDataFrame(
        [(1, "x1", "@a", "A", "hall", True, "t"), (2, None, "@b", "B", "hall", True, None)],
        "entity_id BIGINT, external_id STRING, handle STRING, name STRING, category STRING, active BOOLEAN, thumbnail_url STRING",
    )
    wanted = spark.createDataFrame(
        [(0, "x1", None, "A1", "media", True), (1, "x2", "@b", "B1", "media", False), (2, "x3", "@c", "C", "other", True)],
        "position INT, external_id STRING, handle STRING, name STRING, category STRING, active BOOLEAN",
    )
    got = rows(seeding.upsert_entities(entities, wanted), "entity_id", "external_id", "handle", "name", "active", "thumbnail_url")
    assert got == [(1, "x1", "@a", "A1", True, "t"), (2, "x2", "@b", "B1", False, None), (None, "x3", "@c", "C", True, None)]


# -- updates -----------------------------------------------------------------------


def test_ingest_twice_inserts_once(spark, rows):
    entities = spark.createDataFrame(
        [(1, "x1", "@a", "A", True, None), (2, "x2", "@b", "B", True, None), (3, None, "@c", "C", True, None)],
        "entity_id BIGINT, external_id STRING, handle STRING, name STRING, active BOOLEAN, thumbnail_url STRING",
    )
    stats = spark.createDataFrame([("x1", "A!", "pic", 10, 20, 3)], "external_id STRING, name STRING, thumbnail_url STRING, subscriber_count BIGINT, view_count BIGINT, video_count BIGINT")
    empty = spark.createDataFrame([], "entity_id BIGINT, date DATE")
    first = ingest.ingest_entity_snapshots(entities, empty, stats, "2026-07-17")
    assert rows(first.snapshots, "entity_id", "subscriber_count") == [(1, 10)]
    assert tuple(first.metrics.first()) == (2, 1, 1, False)
    assert rows(first.entities, "entity_id", "name", "refreshed") == [(1, "A!", True), (2, "B", False), (3, "C", False)]
    second = ingest.ingest_entity_snapshots(first.entities.drop("refreshed"), first.snapshots, stats, "2026-07-17")
    assert second.snapshots.isEmpty() and tuple(second.outcome.first()) == (0, 1)
    assert rows(second.entities, "refreshed") == [(False,)] * 3
    nothing = A.run_metrics(stats.limit(0), stats, "external_id").first()
    assert (nothing.requested, nothing.is_successful) == (0, False)


def test_reclassification(spark, rows):
    items = spark.createDataFrame(
        [("v1", 1, "動画 #shorts", 30, "none", "standard"), ("v2", 1, "実戦", None, None, "standard"), ("v3", 1, "実戦", None, "none", "unknown"), ("v4", 1, "実機配信", 3600, "none", "live")],
        "item_id STRING, entity_id BIGINT, title STRING, duration_seconds BIGINT, live_flag STRING, content_type STRING",
    )
    entities = spark.createDataFrame([(1, "individual")], "entity_id BIGINT, category STRING")
    metadata = spark.createDataFrame(
        [("v3", 40, "none", None)], "item_id STRING, duration_seconds BIGINT, live_flag STRING, live_details STRUCT<actualStartTime: STRING, actualEndTime: STRING, scheduledStartTime: STRING>"
    )
    plan = I.reclassify(items, entities, metadata)
    assert rows(plan.updates, "item_id", "content_type") == [("v1", "short"), ("v3", "short"), ("v4", "live")]
    assert rows(plan.failures, "item_id") == [("v2",)]
    assert rows(plan.transitions()) == [("standard", "short", 1), ("unknown", "short", 1)]
    assert rows(I.reclassify(items, entities, metadata, refresh=True).updates, "item_id") == [("v3",)]
    assert rows(I.metadata_requests(items)) == [("v2",), ("v3",)]


def test_digest_replaces_its_week(spark, rows, folder):
    week = lambda w, t: spark.createDataFrame([(w, t, "b")], "week_of STRING, title STRING, body_markdown STRING")
    for w, t in (("2026-07-06", "one"), ("2026-07-13", "two"), ("2026-07-13", "three")):
        sinks.write_digest(week(w, t), f"{folder}/digest")
    got = tables.scan(spark, f"{folder}/digest").select(F.col("week_of").cast("string"), "title")
    assert rows(got) == [("2026-07-06", "one"), ("2026-07-13", "three")]


def test_preferred_links(spark, rows):
    links = spark.createDataFrame(
        [(1, "v1", 1, "manual", 100), (2, "v1", 1, "manual_excluded", 0), (3, "v2", 1, "alias", 85), (4, "v2", 1, "exact_name", 10), (5, "v3", 1, "alias", 75), (6, "v3", 1, "alias", 85)],
        "link_id BIGINT, item_id STRING, catalog_id BIGINT, method STRING, confidence INT",
    )
    assert rows(L.preferred_links(links), "item_id", "link_id") == [("v1", 2), ("v2", 4), ("v3", 6)]


def test_schemas_and_keys(spark, rows):
    from risemeter import schemas

    for name in schemas.SCHEMAS:
        table = schemas.empty(spark, name)
        assert set(schemas.UNIQUE_KEYS.get(name, [])) <= set(table.columns)
    entities = spark.createDataFrame([(None,), (None,), ("x",), ("x",)], "external_id STRING")
    assert rows(schemas.key_problems({"entities": entities})) == [("entities", "x", 2)]


def test_raw_snapshots_count_once_a_day(spark, rows):
    cast = [(1, "2026-07-08", 130, at(9)), (1, "2026-07-08", 120, at(2)), (1, "2026-07-01", 100, at(9)), (1, "2026-07-01", 90, at(2))]
    raw = spark.createDataFrame(cast, "item_id BIGINT, date STRING, view_count BIGINT, collected_at TIMESTAMP")
    trends = I.item_trends(raw.withColumn("date", F.to_date("date")), 7)
    assert rows(trends, "item_id", "delta", "comparison_days") == [(1, 30, 7)]


def test_answers_are_typed_once_and_stay_behind(spark):
    """A field is read from an element for its type and its value, not again for every use; the answer does not travel with its elements."""
    sent = spark.createDataFrame([(1, 0, 7, 70), (1, 1, 8, 80), (2, 0, 9, 90)], "batch_id BIGINT, candidate_index BIGINT, item_id BIGINT, catalog_id BIGINT")
    answer = '[{"candidateIndex": 0, "machineId": 70, "confidence": 0.95}, {"candidateIndex": 1, "confidence": "0.9"}, {"candidateIndex": 1, "confidence": 0.8}, 5]'
    responses = spark.createDataFrame([(1, answer), (2, '{"a": 1}'), (3, "[]"), (4, None)], "batch_id BIGINT, response_text STRING")
    items = spark.createDataFrame([(7, "pending"), (8, "pending")], "item_id BIGINT, match_status STRING")
    links = spark.createDataFrame([], "item_id BIGINT, catalog_id BIGINT")
    summary = R.apply_judgments(sent, responses, items, links).summary
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.candidateIndex") == 2 and plan.count("$.confidence") == 2
    assert not any("min_by" in line and "response_text" in line for line in plan.splitlines())
    assert [tuple(r) for r in summary.collect()] == [(3, 1, 1, 0, 1)]


def test_answers_are_not_gathered_by_an_estimate(spark, folder):
    """Answers beyond the limit of a broadcast are sorted, though Spark estimates their elements at less than that."""
    elements = "transform(sequence(0, 4), i -> to_json(named_struct('candidateIndex', i, 'machineId', id, 'confidence', 0.95, 'reason', sha2(string(id * 5 + i), 256))))"
    spark.range(400).selectExpr("id AS batch_id", f"concat('[', concat_ws(',', {elements}), ']') AS response_text").write.parquet(f"{folder}/answers")
    responses = spark.read.parquet(f"{folder}/answers")
    limit = 30_000
    assert responses._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > limit
    sent = spark.range(2000).selectExpr("id div 5 AS batch_id", "id % 5 AS candidate_index", "id AS item_id", "id div 5 AS catalog_id")
    items = spark.range(2000).selectExpr("id AS item_id", "'pending' AS match_status")
    links = spark.createDataFrame([], "item_id BIGINT, catalog_id BIGINT")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit))
    try:
        done = R.apply_judgments(sent, responses, items, links)
        for table in (done.judgments, done.summary):
            table.collect()
            assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
        assert done.judgments.where("status = 'auto_linked' AND judged_catalog_id = catalog_id").count() == 2000
        assert [tuple(r) for r in done.summary.collect()] == [(2000, 2000, 0, 0, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
