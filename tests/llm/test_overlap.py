"""The shingle join against brute force."""

import random

import numpy as np
import pytest

from risemeter.llm import overlap
from risemeter.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    """Component of every (doc_id, text) row, by its place."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is not None and rows[b][0] is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return [None if rows[k][0] is None else min(groups[root(k)]) for k in range(len(rows))], [len(s) for s in sets]


def corpus(seed):
    dice = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = dice.choices(vocabulary, k=30)
    rows = []
    for i in range(160):
        words = dice.choices(vocabulary, k=dice.randint(1, 80))
        if i % 3 == 0:
            at = dice.randint(0, len(words))
            words[at:at] = passage  # a passage that a third of all documents hold
        rows.append((i, " ".join(words)))
    base = dice.choices(vocabulary, k=60)
    for i in range(160, 260):  # near copies, some at the edge of the threshold
        words = list(base)
        for _ in range(dice.randint(0, 3)):
            words[dice.randrange(len(words))] = dice.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(300 + k, rows[5][1].upper()) for k in range(20)]  # copies
    rows += [(400, None), (401, ""), (402, " \t\n"), (None, rows[5][1]), (403, "one two"), (404, "One\ttwo"), rows[7], rows[7], (8, "other text under a known id")]
    rows += [(405, "x" * 50_000 + " " + "y z " * 20_000), (406, "Ünï coDe wörds ARE kept as they are")]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "short"), [(1, 2), (32, 32)])
def test_components_equal_brute_force(spark, block, short):
    rows = corpus(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n", "1 as k1", "'y' as text_key")
    found = overlap.overlap_components(docs, block=block, short=short).collect()
    wanted, sizes = brute(rows)
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in found) == order((i, n, c) for (i, _), n, c in zip(rows, sizes, wanted, strict=True))


def test_empty_table(spark):
    assert overlap.overlap_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_component_stays(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as _id", "'z' as _key")
    kept = overlap.one_per_component(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    wanted, sizes = brute(rows)
    whole = {i for (i, _), c, n in zip(rows, wanted, sizes, strict=True) if i is not None and i == c and n}
    rest = [i for (i, _), n in zip(rows, sizes, strict=True) if i is None or not n]
    assert got == sorted([*whole, *rest], key=repr)


def test_star_contraction_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 101), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 103: 100}


def test_the_task_count_finds_frequent_grams(spark):
    passage = " ".join(f"p{k}" for k in range(8))
    docs = spark.createDataFrame([(i, passage + f" a{i} b{i} c{i} d{i} e{i}") for i in range(50)], "doc_id long, text string")
    grams, counts = overlap.frequent_grams(overlap.describe(docs, share=0.5), share=0.5)
    assert len(grams) == 4 and set(counts) == {50}


def test_leaders_are_dealt_to_several_tasks(spark):
    sets = spark.createDataFrame([(k, 4, [1, 2, 3, 10 + (k if k % 3 else 0)]) for k in range(30)], "node long, n int, grams array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 30)], "a long, b long")
    found = overlap.linked(pairs, sets, percent=75, followers=4)
    assert {r.b for r in found.collect()} == {k for k in range(1, 30) if k % 3 == 0}


def test_the_order_is_from_the_rarest_on(spark):
    sets = spark.createDataFrame([(1, 4, [1, 2, 3, 4]), (2, 4, [1, 2, 3, 5]), (3, 4, [1, 2, 6, 7])], "node long, n int, grams array<long>")
    found = {(r.k1, r.gram, r.pos) for r in overlap.rare_columns(sets, 50).collect()}
    # Three of four are columns: n-grams of one set take the first places, then 3 (two sets), then 1 and 2.
    assert found == {(1, 3, 1), (1, 1, 2), (2, 3, 1), (2, 1, 2), (3, 1, 2)}


def test_documents_with_one_template(spark):
    """A template that all documents share, in one third of them nearly the whole text: no links but those of brute force."""
    dice = random.Random(12)
    template = " ".join(f"t{k}" for k in range(40))
    rows = [(i, f"{template} " + " ".join(f"w{dice.randrange(900)}" for _ in range(dice.choice([4, 12, 30])))) for i in range(150)]
    found = overlap.overlap_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted, _ = brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, c) for (i, _), c in zip(rows, wanted, strict=True))


def test_signatures_never_exceed_the_difference():
    dice = np.random.default_rng(4)
    for _ in range(300):
        pool = dice.integers(0, 2**63, 400).astype(np.uint64)
        one, two = (np.unique(dice.choice(pool, int(dice.integers(1, 400)))) for _ in range(2))
        assert overlap.least_difference(overlap.signature(one), overlap.signature(two)) <= len(np.setxor1d(one, two))
