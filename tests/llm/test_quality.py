"""The factorisation machine."""

import itertools
import random

import numpy as np

from risemeter.llm import quality


def test_pairs_in_linear_time_equal_all_pairs():
    dice = np.random.default_rng(1)
    machine = quality.Machine(0.3, dice.normal(size=quality.WIDTH), dice.normal(size=(quality.WIDTH, quality.RANK)))
    ids, x = dice.choice(quality.WIDTH, 20, replace=False), dice.random(20)
    slow = machine.bias + sum(machine.linear[i] * w for i, w in zip(ids, x))
    slow += sum(float(machine.factors[ids[a]] @ machine.factors[ids[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(20), 2))
    assert abs(machine.logit(ids, x) - slow) < 1e-9


def test_interactions_are_learned():
    dice = random.Random(2)
    rows = []
    for _ in range(1500):  # exclusive or: no linear model can tell
        a, b = dice.randint(0, 1), dice.randint(0, 1)
        rows.append((np.array([a, 2 + b]), np.ones(2), a ^ b))
    machine = quality.fit(rows, epochs=30)
    assert all((machine.score(i, x) >= 0.5) == bool(y) for i, x, y in rows)


def make(spark, n=600):
    dice = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        text = " ".join(dice.choices(words, k=dice.randint(5, 60)))
        docs.append((i, text if good else " ".join(f"{w}$$$" for w in text.upper().split()), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = make(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = [r for r in quality.quality_scores(docs, labels).collect() if r.held_out]
    assert len(found) > 80 and sum(r.predicted == truth[r.doc_id] for r in found) / len(found) > 0.97


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    docs, labels = make(spark, 200)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality")
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'other' as source", "n_chars", "1 as score")
    first = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert first == {r.doc_id: r.score for r in quality.quality_scores(other, flipped).collect()}


def test_nulls_repeats_and_missing_labels(spark):
    docs, labels = make(spark, 200)
    odd = spark.createDataFrame([(None, None, None), (1, None, 5), (900, "", None), (901, "x" * 200_000, 3), (901, "x" * 200_000, 3)], "doc_id long, text string, n_chars long")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 0, 1), (7, 9, 0)], labels.schema))
    found = quality.quality_scores(docs.select("doc_id", "text", "n_chars").unionByName(odd), labels).collect()
    assert len(found) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    none = quality.quality_scores(odd, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert quality.keep_good(odd, labels.where("false")).count() == 5
    assert quality.quality_scores(docs.where("false"), labels).collect() == []
    kept = quality.keep_good(docs.selectExpr("*", "7 as score"), labels)
    assert kept.columns == [*docs.columns, "score"] and 120 <= kept.count() <= 160
