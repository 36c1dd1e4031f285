"""SimHash and covering tables against brute force."""

import itertools
import random

import pytest
import xxhash

from risemeter.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(points):
    """The smallest member that each of the points reaches."""
    parent = {p: p for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(points, 2):
        if ((a ^ b) % 2**64).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {p: root(p) for p in points}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def flipped(dice, x, n):
    for i in dice.sample(range(64), n):
        x ^= 1 << i
    return x


@pytest.mark.parametrize("free", [-1, (1 << 30) - 1, 0b1011001])
def test_every_pair_within_the_radius_agrees_on_a_table(free):
    bits = [i for i in range(64) if free >> i & 1]
    tables = simhash.masks(free)
    assert all(m & ~free == 0 for m in tables)
    dice = random.Random(1)
    some = itertools.combinations(bits, 3) if len(bits) < 10 else (dice.sample(bits, 3) for _ in range(2000))
    for differing in some:
        assert any(not any(m >> i & 1 for i in differing) for m in tables)


def test_a_text_without_words_is_zero():
    assert simhash.fingerprint([]) == 0


def test_long_texts_are_hashed_in_runs(monkeypatch):
    dice = random.Random(2)
    text = " ".join(dice.choices(["a", "b", "c", "dd"], k=500))
    wanted = signed(plain_fingerprint(text))
    for step in (1, 7, 498, 499, 1000):
        monkeypatch.setattr(simhash, "STEP_WORDS", step)
        assert simhash.fingerprint(text.encode().split()) == wanted


@pytest.mark.parametrize(("bucket", "width"), [(64, 8), (3, 2), (2, 1)])
def test_components_of_points(spark, bucket, width):
    dice = random.Random(bucket)
    points = {dice.getrandbits(64) for _ in range(150)}
    base = dice.getrandbits(64)
    points |= {flipped(dice, base, dice.randint(0, 9)) for _ in range(120)}  # many in one bucket, few links
    dense = dice.getrandbits(64)
    points |= {flipped(dice, dense, dice.randint(0, 3)) for _ in range(120)}
    low = dice.getrandbits(64)
    points |= {low ^ dice.getrandbits(20) for _ in range(100)}  # all in a corner
    points = [signed(p) for p in points]
    found = simhash.covering_links(spark.createDataFrame([(p,) for p in points], "fp long"), bucket=bucket, width=width)
    got = {r.node: r.root for r in found.collect()}
    assert {p: got.get(p, p) for p in points} == brute(sorted(points))


def test_documents(spark):
    dice = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    base = dice.choices(vocabulary, k=200)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(dice.randint(0, 4)):
            words[dice.randrange(len(words))] = dice.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(dice.choices(vocabulary, k=dice.randint(1, 60)))) for i in range(60)]
    rows += [(200 + i, rows[3][1].upper()) for i in range(30)] + [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "One\x0btwo"), (305, "Ünï coDe \x1c wörds here and there")]
    rows += [(None, rows[0][1]), rows[5], rows[5], (5, "another text under a known id"), (306, "x" * 40_000 + " y z" * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as mask", "3 as n")
    found = simhash.near_duplicates(frame).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    reach = brute(sorted({p for (i, _), p in zip(rows, prints, strict=True) if i is not None}))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[reach[p]] = min(i, least.get(reach[p], i))
    wanted = [(i, f"{p:016x}", None if i is None else least[reach[p]]) for (i, _), p in zip(rows, prints, strict=True)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == sorted(wanted, key=repr)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
