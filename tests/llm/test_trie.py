"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from risemeter.llm import trie

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(r)] for c, r in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def brute(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    for key, ids in members.items():
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", key[-1][1]) if w]) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(ids) - 1) * words
    rows = []
    for key, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(sequences[c]) == len(key))))
        parent = min(members[key[:-1]]) if key else None
        rows.append((min(ids), len(key), parent, len(ids), len(children.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def talk(seed, n=120):
    dice = random.Random(seed)
    lines = [("user", "a b c"), ("assistant", "d  e"), (None, "f"), ("user", None), ("system", " x y"), ("user", "")]
    rows = []
    for c in range(-30, n):
        if c % 7 == 3:
            continue
        for turn in range(dice.choice([1, 2, 3, 5, 9, 14])):
            role, text = dice.choice(lines[:2] if dice.random() < 0.8 else lines)
            rows.append((c, turn if dice.random() < 0.95 else None, role, text))
    rows += rows[:9]
    rows += [(500, t, "user", f"long {t}") for t in range(70)] + [(501, t, "user", f"long {t}") for t in range(70)] + [(None, 1, "user", "lost"), (600, None, None, None)]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [trie.STRING, 4])
def test_nodes_equal_brute_force(spark, length):
    rows = talk(length)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "2 as low", "'x' as x")
    found = trie.conversation_trie(frame, length)
    assert sorted((tuple(r[f] for f in FIELDS) for r in found.collect()), key=repr) == brute(rebuild(rows))


def test_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_only_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, depth long, hx long, hy long, words long")
    found = trie.prefix_trie(empty, spark.createDataFrame([(4,), (3,)], "conv_id long")).collect()
    assert [tuple(r[f] for f in FIELDS) for r in found] == brute({3: [], 4: []})


def test_a_chain_of_snapshots(spark):
    """Every prefix of one conversation is a conversation of its own."""
    turns = [(c, d, d * 7919 + 1, d * 104729 + 3, 2) for c in range(1, 41) for d in range(1, c + 1)]
    found = trie.prefix_trie(spark.createDataFrame(turns, "conv_id long, depth long, hx long, hy long, words long"), spark.range(1, 41).withColumnRenamed("id", "conv_id"), 16)
    got = {(r.depth, r.n_convs, r.n_leaves) for r in found.collect()}
    assert got == {(0, 40, 1), *((d, 41 - d, 1) for d in range(1, 41))}


def test_ends_of_a_node_pass_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)
    ids = [5, 100, 7, 20, 3, 11, 8]
    found = trie.prefix_trie(spark.createDataFrame([(c, 1, 1, 2, 1) for c in ids], "conv_id long, depth long, hx long, hy long, words long"), spark.createDataFrame([(c,) for c in ids], "conv_id long"))
    assert {r.depth: r.ends_sha256 for r in found.collect()}[1] == hashlib.sha256(b"3,5,7,8,11,20,100").hexdigest()
