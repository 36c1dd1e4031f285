"""Title matching: reference vectors, brute force, and the shuffled path."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from risemeter.operators import matching as M
from risemeter.plans.rematch import rematch

CATALOG = (
    "catalog_id BIGINT, name STRING, short_name STRING, aliases ARRAY<STRING>, unique_aliases ARRAY<STRING>, "
    "ambiguous_aliases ARRAY<STRING>, resolving_keywords ARRAY<STRING>, exclude_terms ARRAY<STRING>"
)


def entry(i, name, short=None, aliases=None, unique=None, ambiguous=None, resolving=None, exclude=None):
    return (i, name, short, aliases, unique, ambiguous, resolving, exclude)


BASE = [
    entry(1, "スマスロ北斗の拳", "北斗", ["北斗の拳", "スマスロ北斗"]),
    entry(2, "P海物語 極JAPAN", "海", ["極海物語JAPAN"]),
    entry(3, "P/eフィーバーブルーロック Light ver.", "ブルーロック Light", ["ブルーロックLight", "Fブルーロック"]),
    entry(4, "eフィーバーブルーロック", "ブルーロック", ["ブルーロック"]),
    entry(5, "Q海物語 極JAPAN", exclude=["釣り"]),
    entry(10, "P Dragon Quest 12", "Dragon Quest 12"),
    entry(11, "P Official Machine Beta", unique=["Beta Special"]),
    entry(12, "P Resolving Machine", ambiguous=["popular machine"], resolving=["resolving machine"]),
    entry(13, "P Ocean 5"),
    entry(14, "P Ocean 5 Special"),
    entry(15, "P Zaxxon A", unique=["Zaxxon A Light"], ambiguous=["common cabinet"], resolving=["Zaxxon A"]),
    entry(16, "x"),
    entry(17, "Never", exclude=["・"]),
]
TITLES = {
    "新台 スマスロ北斗の拳 実戦": {(1, "exact_name", 100)},
    "新台 北斗の拳を打つ": {(1, "alias", 85)},
    "P海物語 極JAPANを打つ": {(2, "exact_name", 100)},
    "今日は海へ行く": set(),
    "スマスロ北斗とP海物語 極JAPANを比較": {(1, "alias", 85), (2, "exact_name", 100)},
    "釣りでQ海物語 極JAPAN": set(),
    "P/eフィーバーブルーロック Light ver. 初打ち": {(3, "exact_name", 100)},
    "新台　ブルーロック　ｌｉｇｈｔ　ｖｅｒ．実戦": {(3, "alias", 85)},
    "無関係な動画タイトル": set(),
    "P Dragon Quest 12 実戦": {(10, "exact_name", 100)},
    "Dragon Quest 12 実戦": {(10, "alias", 85)},
    "Beta Special 実戦": {(11, "alias", 85)},
    "popular machine 実戦": set(),
    "popular machine resolving machine": {(12, "alias", 75)},
    "P Ocean 5 Special 実戦": {(14, "exact_name", 100)},
    "Zaxxon A Light common cabinet Zaxxon A": {(15, "alias", 85)},
    "x": {(16, "exact_name", 100)},
    "Never": set(),
    "": set(),
}


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.item_id, set()).add((r.catalog_id, r.method, r.confidence))
    return out


def test_reference_vectors(spark):
    catalog = spark.createDataFrame(BASE, CATALOG)
    items = spark.createDataFrame([(t, t) for t in TITLES], "item_id STRING, title STRING")
    got = found(M.match_titles(items, catalog))
    # The one-letter name is contained in every title with that letter, as names have no length rule.
    for title, expected in TITLES.items():
        letter = {(16, "exact_name", 100)} if "x" in title.lower() and "zaxxon" not in title.lower() else set()
        assert got.get(title, set()) == expected | letter, title


def normal(text):
    text = unicodedata.normalize("NFKC", text).lower()
    return re.sub(r"[\s・･\-_()\[\]【】「」『』]", "", text)


def safe(text, any_script=4, ascii_only=6):
    n = normal(text)
    return len(n) >= any_script and (not re.fullmatch("[a-z0-9]+", n) or len(n) >= ascii_only)


def brute(title, catalog):
    """The rule stated directly over all pairs."""
    text, hits, review = normal(title), [], set()
    for i, name, short, aliases, unique, ambiguous, resolving, exclude in catalog:
        if any(normal(t) in text for t in exclude or []):
            continue
        listed = [t for t in [short, *(aliases or []), *(unique or [])] if t]
        inside = [t for t in listed if safe(t) and normal(t) in text]
        if normal(name) and normal(name) in text:
            hits.append((i, "exact_name", 100, name))
        elif inside:
            hits.append((i, "alias", 85, max(inside, key=len)))
        else:
            doubtful = [t for t in ambiguous or [] if safe(t) and normal(t) in text]
            if doubtful and any(normal(t) in text for t in resolving or []):
                hits.append((i, "alias", 75, doubtful[0]))
        confirmed = any(safe(t) and normal(t) in text for t in [name, *listed])
        sources = [t for t in [name, short, *(aliases or []), *(unique or []), *(ambiguous or [])] if t]
        tokens = {p for t in sources for p in re.split(r"[\s・･\-_()\[\]【】「」『』]+", unicodedata.normalize("NFKC", t)) if p}
        if not confirmed and any(safe(t, 3, 5) and normal(t) in text for t in tokens):
            review.add(i)
    kept = {
        h for h in hits
        if not any(o[0] != h[0] and len(normal(o[3])) > len(normal(h[3])) and normal(h[3]) in normal(o[3]) for o in hits)
    }
    return kept, review


@pytest.fixture(scope="module")
def crowd():
    """A catalog with shared prefixes and a title set in which one phrase fills a third of the rows."""
    random.seed(11)
    parts = ["スマスロ", "パチスロ", "北斗", "海物語", "Light", "Quest", "無双", "第2章", "神", "Ver.", "極", "abc", "ｅフィーバー"]
    word = lambda n: random.choice([" ", "", "・"]).join(random.choices(parts, k=n))
    maybe = lambda make: make() if random.random() < 0.4 else None
    catalog = [
        entry(
            i, word(random.randint(1, 4)), maybe(lambda: word(2)), maybe(lambda: [word(2), word(3)]), maybe(lambda: [word(3)]),
            maybe(lambda: [word(2), word(1)]), maybe(lambda: [word(1)]), [word(2)] if random.random() < 0.1 else None,
        )
        for i in range(60)
    ]
    titles = [word(random.randint(1, 9)) for _ in range(200)] + ["スマスロ北斗 実戦 " + word(3) for _ in range(100)]
    return catalog, titles


@pytest.mark.parametrize("most_bits", [M.MOST_BITS, 64])
def test_brute_force(spark, crowd, most_bits, monkeypatch):
    """A bit table that is too small passes more n-grams and changes no row."""
    monkeypatch.setattr(M, "MOST_BITS", most_bits)
    catalog, titles = crowd
    index = M.index_catalog(spark.createDataFrame(catalog, CATALOG))
    items = spark.createDataFrame(list(enumerate(titles)), "item_id BIGINT, title STRING")
    rows = M.judged_pairs(M.title_hits(items, index), index).collect()
    matches, review = {}, {}
    for r in rows:
        if r.is_match:
            matches.setdefault(r.item_id, set()).add((r.catalog_id, r.method, r.confidence, r.term))
        if r.is_ambiguous:
            review.setdefault(r.item_id, set()).add(r.catalog_id)
    for i, title in enumerate(titles):
        kept, doubtful = brute(title, catalog)
        assert matches.get(i, set()) == kept, title
        assert review.get(i, set()) == doubtful, title


def exchanges(plan, above=()):
    """(exchange, operators below it down to the next exchange) of a physical plan, as text lines by depth."""
    lines = [(len(re.match(r"[ :+-]*", line).group()), line.strip(" :+-")) for line in plan.splitlines() if line.strip()]
    found = []
    for k, (depth, name) in enumerate(lines):
        if re.match(r"(\*\(\d+\) )?Exchange", name):
            below = []
            for d, n in lines[k + 1 :]:
                if d <= depth:
                    break
                below.append(n)
            found.append((name, below))
    return found


def physical(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].split("Subqueries")[0]


def test_only_known_ngrams_move_and_titles_are_normalized_once(spark, crowd):
    """The same plan with joins that are sorted, as for a catalog beyond any broadcast, and with small ones."""
    catalog, titles = crowd
    items = spark.createDataFrame(list(enumerate(titles)), "item_id BIGINT, title STRING")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in ("-1", before):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            index = M.index_catalog(spark.createDataFrame(catalog, CATALOG))
            plan = physical(M.title_hits(items, index))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        moved = [below for _, below in exchanges(plan) if any("Generate explode" in b for b in below)]
        for below in moved:
            first = next(k for k, b in enumerate(below) if "Generate explode" in b)
            assert any("ubquery" in b and "Filter" in b for b in below[:first]), plan
        assert (threshold == "-1") == bool(moved)
        normalizers = {below[0] for name, below in exchanges(plan) if "ArrowEvalPython" in " ".join(below[:3])}
        assert len(normalizers) <= 1 and "Window" not in plan


def test_covering_terms_are_facts_of_the_catalog(spark):
    index = M.index_catalog(spark.createDataFrame([entry(1, "Ocean 5 Special"), entry(2, "Ocean 5"), entry(3, "cean 5 Sp"), entry(4, "Other")], CATALOG), M.MATCHING_ROLES)
    names = {r.term_id: r.term_text for r in index.terms.collect()}
    got = {(names[r.longer_id], names[r.term_id]) for r in M.covering_terms(index).collect()}
    assert got == {("ocean5special", "ocean5"), ("ocean5special", "cean5sp")}


def test_stored_normal_text_is_used(spark):
    catalog = spark.createDataFrame([entry(1, "Long Name Here")], CATALOG)
    items = spark.createDataFrame([(1, "ignored", "xxlongnameherexx")], "item_id BIGINT, title STRING, title_text STRING")
    assert found(M.match_titles(items, catalog)) == {1: {(1, "exact_name", 100)}}


REMATCH = [
    entry(1, "P機種A名称", "機種A名称", unique=["機種Aライト"]),
    entry(2, "P機種B", ambiguous=["人気機種"], resolving=["機種B"]),
]


def decide(spark, videos, links):
    items = spark.createDataFrame(videos, "item_id STRING, title STRING, match_status STRING")
    linked = spark.createDataFrame(links, "item_id STRING, catalog_id BIGINT, confidence INT, method STRING")
    done = rematch(items, spark.createDataFrame(REMATCH, CATALOG), linked)
    return {r.item_id: r for r in done.decisions.collect()}, done


def test_rematch_protects_manual_links(spark):
    links = [("v1", 1, 100, "manual"), ("v1", 2, 0, "manual_excluded"), ("v2", 1, 100, "exact_name"), ("v4", 2, 0, "manual_excluded")]
    videos = [
        ("v1", "機種A 実戦 機種B", "matched"), ("v2", "機種A名称 機種B 機種B", "unmatched"), ("v3", "人気機種を紹介", "unmatched"),
        ("v4", "無関係な動画", "matched"), ("v5", "機種Aライト", "unmatched"), ("v6", "機種Aライト", "manual_excluded"),
    ]
    by_item, done = decide(spark, videos, links)
    assert (by_item["v1"].links_to_add, by_item["v1"].preserved_manual, by_item["v1"].planned_status) == (0, 2, "matched")
    assert (by_item["v2"].matches, by_item["v2"].links_to_add, by_item["v2"].planned_status) == (1, 0, "matched")
    assert (by_item["v3"].matches, by_item["v3"].ambiguous_entries, by_item["v3"].planned_status) == (0, 1, "ambiguous")
    assert by_item["v4"].planned_status == "unmatched"
    assert (by_item["v5"].links_to_add, by_item["v5"].planned_status) == (1, "matched")
    assert by_item["v6"].planned_status == "manual_excluded"
    summary = {r.measure: r.amount for r in done.summary.collect()}
    assert summary == {
        "total_items": 6, "matched": 3, "ambiguous": 1, "unmatched": 1, "links_to_add": 2, "existing_links": 4, "exclusions_preserved": 2
    }
    # A second run over the result adds nothing.
    added = [(r.item_id, r.catalog_id, r.confidence, r.method) for r in done.links_to_add.collect()]
    _, again = decide(spark, videos, links + added)
    assert again.links_to_add.isEmpty()


def test_matching_entries(spark):
    catalog = spark.createDataFrame(BASE, CATALOG)
    items = spark.createDataFrame([(1, "Beta Special"), (2, "P Ocean 5 Special")], "item_id BIGINT, title STRING")
    got = {r.catalog_id for r in M.matching_entries(items, catalog).select(F.col("catalog_id")).collect()}
    assert got == {11, 14}
