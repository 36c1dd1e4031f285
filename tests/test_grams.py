"""Rolling n-gram hashes, and how often title matching makes them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risemeter.functions import grams, text as T
from risemeter.operators import matching as M

LENGTHS = [1, 2, 3, 4, 8, 16]


def naive(text):
    return {g: int(grams.text_hashes([g], [n])[0][0]) for n in LENGTHS for g in {text[i : i + n] for i in range(len(text) - n + 1)}}


@pytest.mark.parametrize("size", [1 << 19, 5])
def test_hashes_are_those_of_all_ngrams(size, monkeypatch):
    """Also over texts cut into slices, astral characters, empty and missing texts; no n-gram spans two texts."""
    monkeypatch.setattr(grams, "SLICE", size)
    random.seed(4)
    texts = ["".join(random.choices("ab日𝒳 ", k=random.randint(0, 40))) for _ in range(40)] + ["", None, "a"]
    got = grams.text_hashes(texts, LENGTHS)
    assert len(got) == len(texts)
    for text, hashes in zip(texts, got, strict=True):
        own = naive(text or "")
        assert sorted(hashes.tolist()) == sorted(own.values()), text
        assert len(set(own.values())) == len(own)


def test_bit_table_lets_its_own_pass():
    table = np.zeros(16, dtype=np.uint64)
    wanted = int(grams.text_hashes(["needle--"], [8])[0][0])
    place = wanted & (16 * 64 - 1)
    table[place >> 6] |= np.uint64(1 << (place & 63))
    held, none = grams.text_hashes(["a needle-- in hay", "x"], [8], table)
    assert wanted in held.tolist() and len(held) < 9 and len(none) == 0


def test_ngrams_are_made_by_one_pass_and_hits_once(spark):
    """No pattern runs over the titles, and the judged pairs read hits that were made before."""
    catalog = spark.createDataFrame(
        [(1, "Ocean 5 Special", None, None, None, None, None, None), (2, "Ocean 5", None, None, None, None, None, None)],
        "catalog_id BIGINT, name STRING, short_name STRING, aliases ARRAY<STRING>, unique_aliases ARRAY<STRING>, "
        "ambiguous_aliases ARRAY<STRING>, resolving_keywords ARRAY<STRING>, exclude_terms ARRAY<STRING>",
    )
    items = spark.createDataFrame([(1, "Ocean 5 Special"), (2, "an Ocean 5 day")], "item_id BIGINT, title STRING")
    index = M.index_catalog(catalog)
    hits = M.title_hits(items, index)
    assert "regexp_extract_all" not in hits._jdf.queryExecution().optimizedPlan().toString()
    pairs = M.judged_pairs(hits, index)
    assert "title_text" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.item_id, r.catalog_id) for r in pairs.where("is_match").collect()} == {(1, 1), (2, 2)}


def test_weak_tokens_lengths(spark, rows):
    """Units, not code points, count; ASCII letters and digits need five."""
    texts = ["ab abc abcd ABCDE ab1c2 北斗 海物語 𝒳日 日𝒳 İİ a.b a-b-c \u3000神 神", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    tokens = T.weak_tokens(F.array("t"))
    assert "regexp_replace" not in df.select(tokens)._jdf.queryExecution().optimizedPlan().toString()
    expected = ["ABCDE", "ab1c2", "海物語", "İİ", "a.b"]
    assert rows(df.select(tokens)) == sorted([(expected,), ([],)], key=repr)


def test_titles_are_hashed_once(spark):
    """Neither the hits nor their plan hash or normalize a title again; the check sees a text once, with all its candidates."""
    catalog = spark.createDataFrame(
        [(1, "Ocean 5 Special", None, None, None, None, ["ocean five"], ["Lake"]), (2, "Ocean 5", None, None, None, ["Sea six"], ["lake two"], None)],
        "catalog_id BIGINT, name STRING, short_name STRING, aliases ARRAY<STRING>, unique_aliases ARRAY<STRING>, "
        "ambiguous_aliases ARRAY<STRING>, resolving_keywords ARRAY<STRING>, exclude_terms ARRAY<STRING>",
    )
    titles = [(1, "Ocean 5 Special"), (1, "Sea six, Lake two"), (2, "Ocean 5 Special on a Lake"), (None, "Ocean 5"), (3, None), (4, "sea Six")]
    items = spark.createDataFrame(titles, "item_id BIGINT, title STRING")
    index = M.index_catalog(catalog, M.MATCHING_ROLES)
    hits = M.title_hits(items, index)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "hashes(" not in plan and "_nfkc_batch" not in plan
    got = {(r.item_id, r.catalog_id, r.term) for r in hits.where("method is not null").collect()}
    assert got == {(1, 2, "Ocean 5"), (2, 2, "Ocean 5")}


def test_titles_of_one_partition_are_hashed_in_many(spark, monkeypatch):
    """A file with one row group is read by one task; normalizing and hashing do not stay there."""
    catalog = spark.createDataFrame(
        [(1, "Ocean 5 Special", None, None, None, None, None, None)],
        "catalog_id BIGINT, name STRING, short_name STRING, aliases ARRAY<STRING>, unique_aliases ARRAY<STRING>, "
        "ambiguous_aliases ARRAY<STRING>, resolving_keywords ARRAY<STRING>, exclude_terms ARRAY<STRING>",
    )
    items = spark.range(40).selectExpr("id AS item_id", "concat('no ', id, ' Ocean 5 Special') AS title").coalesce(1)
    index, offering, seen = M.index_catalog(catalog), M.offering, []

    def spied(texts, *others):
        seen.append(texts.select("item_id").rdd.getNumPartitions())
        return offering(texts, *others)

    monkeypatch.setattr(M, "offering", spied)
    assert M.title_hits(items, index).where("method = 'exact_name'").count() == 40
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_short_terms_are_their_own_anchors(spark):
    """Else a text that holds only a part of the term is a candidate, and is searched to its end."""
    terms = ["a", "abcde", "abcdefg", "日本語の機種", "abcdefghijklm", "abcdefghijklmnop", "abcdefghijklmnopqrst"]
    rows = spark.createDataFrame([*enumerate(terms)], "term_id BIGINT, term_text STRING")
    got = {r.term_text: r.anchor for r in M.anchored(rows).collect()}
    assert got.keys() == set(terms)
    for term in terms:
        grams_of = {int(grams.text_hashes([term[i : i + 16]], [min(16, len(term))])[0][0]) for i in range(max(1, len(term) - 15))}
        assert got[term] in grams_of


@pytest.mark.parametrize("size", [1 << 16, 5])
def test_places_are_bytes_at_which_the_ngrams_begin(size, monkeypatch):
    """Also behind the cut of a slice and behind characters of two to four bytes, and with a bit table that is folded."""
    monkeypatch.setattr(grams, "SLICE", size)
    monkeypatch.setattr(grams, "FOLDED", 64)
    random.seed(5)
    texts = ["".join(random.choices("abé日𝒳 ", k=random.randint(0, 40))) for _ in range(40)] + ["", None, "a", "日"]
    table = np.full(4, ~np.uint64(0))
    for words in (None, table):
        firsts, hashed, places = grams.text_places(texts, LENGTHS, words)
        for k, text in enumerate(texts):
            own, whole = naive(text or ""), (text or "").encode()
            found = dict(zip(hashed[firsts[k] : firsts[k + 1]].tolist(), places[firsts[k] : firsts[k + 1]].tolist(), strict=True))
            assert found.keys() == set(own.values())
            assert all(whole[found[h] :].startswith(gram.encode()) for gram, h in own.items())


def test_terms_are_found_where_their_anchor_is_not_first(spark):
    """Long terms whose anchor occurs earlier without them, texts of repeated ids, terms behind characters of several bytes."""
    catalog = spark.createDataFrame(
        [(1, "x" * 20 + "abcdefgh", None, None, None, None, None, None), (2, "日本語の機種", None, None, None, None, None, None)],
        "catalog_id BIGINT, name STRING, short_name STRING, aliases ARRAY<STRING>, unique_aliases ARRAY<STRING>, "
        "ambiguous_aliases ARRAY<STRING>, resolving_keywords ARRAY<STRING>, exclude_terms ARRAY<STRING>",
    )
    term, part = "x" * 20 + "abcdefgh", "x" * 16
    titles = [(1, f"{part}é{part}y日{term}"), (2, "xxxxxxxxabcdefgh"), (3, f"ééé𝒳日本語の機種{term}"), (4, "日本語の機"), (5, term), (5, "日本語の機種")]
    items = spark.createDataFrame(titles, "item_id BIGINT, title STRING")
    index = M.index_catalog(catalog, M.MATCHING_ROLES)
    assert {r.anchor_at for r in index.terms.collect()} <= set(range(13))
    got = {(r.item_id, r.catalog_id) for r in M.title_hits(items, index).where("method is not null").collect()}
    assert got == {(1, 1), (3, 1), (3, 2), (5, 1), (5, 2)}
