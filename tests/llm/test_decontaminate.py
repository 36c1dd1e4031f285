"""Edit distances, recall and places of benchmark passages."""

import random

from hypothesis import given, settings, strategies as st

from risemeter.llm import decontaminate as d

SHORT = st.lists(st.integers(0, 2), min_size=1, max_size=9)


def table(pattern, text, anchored):
    last = [j if anchored else 0 for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (p != t)))
        last = row
    return min(last), last.index(min(last))


@settings(max_examples=300, deadline=None)
@given(SHORT, st.lists(st.integers(0, 2), max_size=12), st.booleans())
def test_edit_match_equals_the_table(pattern, text, anchored):
    assert d.edit_match(pattern, text, anchored) == table(pattern, text, anchored)


def make(seed=4):
    dice = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(dice.choices(vocabulary, k=dice.randint(15, 60)))) for k in range(60)]
    return dice, vocabulary, items


def edited(text, edits, dice):
    words = text.split()
    for _ in range(edits):
        kind, at = dice.randint(0, 2), dice.randrange(len(words))
        words[at : at + (kind != 1)] = [] if kind == 2 else [f"new{dice.random()}"]
    return " ".join(words)


def test_recall_and_precision(spark):
    dice, vocabulary, items = make()
    docs, planted = [], set()
    for i in range(400):
        words = dice.choices(vocabulary, k=dice.randint(0, 300))
        if i % 2:
            item, text = items[dice.randrange(60)]
            n = len(text.split())
            at = dice.randint(0, len(words))
            passage = edited(text, dice.randint(0, int(d.MAX_EDITS * n)), dice)
            words[at:at] = (passage.upper() if i % 4 == 1 else passage.replace(" ", "!!\n")).split(" ")
            planted.add((i, item))
        docs.append((i, " ".join(words)))
    found = d.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    hits = {(r.doc_id, r.item_id) for r in found}
    assert hits <= planted and len(hits) >= 0.95 * len(planted)
    texts = dict(docs)
    whole = [r for r in found if r.distance == 0]
    assert whole and all(d._words(__import__("pyarrow").array([texts[r.doc_id][r.start : r.end]]))[0].size == r.item_words for r in whole)


def test_every_length_with_most_edits_is_found_between_other_words():
    dice, vocabulary, _ = make()
    words_of = lambda text: d._words(__import__("pyarrow").array([text]))[0].tolist()
    items = [(k, " ".join(dice.choices(vocabulary, k=n))) for k, n in enumerate([*range(1, 62), 90, 200])]
    index = d.Index([(k, words_of(text)) for k, text in items])
    tried = []
    for k, text in items:
        for _ in range(40):
            sides = [" ".join(dice.choices(vocabulary, k=dice.randint(3, 40))) for _ in range(2)]
            tried.append((k, f"{sides[0]} {edited(text, int(d.MAX_EDITS * len(text.split())), dice)} {sides[1]}"))
    found = index.hits(__import__("pyarrow").array([text for _, text in tried]))
    missed = [len(items[k][1].split()) for (k, _), hits in zip(tried, found, strict=True) if k not in {hit[0] for hit in hits}]
    assert missed == []


def test_blocks_change_nothing(spark, monkeypatch):
    _, _, items = make()
    docs = spark.createDataFrame([(k, "before it " + t + " behind") for k, t in items], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in d.benchmark_hits(docs, benchmark).collect()}
    monkeypatch.setattr(d.item_blocks, "__defaults__", (300,))
    assert len(one) == 60 and one == {tuple(r) for r in d.benchmark_hits(docs, benchmark).collect()}
    assert d.without_benchmark(docs, benchmark).count() == 0


def test_short_items_nulls_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, "  "), (None, "one two three four five six seven eight nine ten"), (4, "solo"), (4, "solo")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x Alpha, beta GAMMA (delta) y"), (2, None), (3, ""), (None, "so one two three four five six seven eight nine ten end"), (5, "alpha beta"), (6, "a solo b"), (7, "z " * 100_000)], "doc_id long, text string"
    ).selectExpr("*", "1 as item_id", "2 as start")
    found = d.benchmark_hits(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance, r.start, r.end) for r in found), key=repr) == [(1, 1, 0, 2, 26), (6, 4, 0, 2, 6), (6, 4, 0, 2, 6), (None, None, 0, 3, 51)]
    kept = d.without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7]
    assert d.benchmark_hits(docs, benchmark.where("false")).collect() == [] and d.without_benchmark(docs, benchmark.where("false")).count() == 7
    assert d.benchmark_hits(docs.where("false"), benchmark).collect() == []
