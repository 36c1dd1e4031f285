"""Conversation repair against a shortest-path search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from risemeter.llm import repair

BREAKS = " \t\n\v\f\r"


def cheapest(rows, entry=0, leave=None):
    """Dijkstra by (cost, edits): the first complete sequence that comes off the queue. States as in the pattern s?(ua)+."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    queue, seen = [(0, "", 0, entry)], set()
    while queue:
        cost, edits, i, at = heapq.heappop(queue)
        if i == len(rows) and (at in (0, 3) if leave is None else at == leave and not edits.endswith("I")):
            return cost, edits
        if (i, at, edits[-1:] == "I") in seen or cost > 3 * len(rows) + 8:
            continue
        seen.add((i, at, edits[-1:] == "I"))
        fresh = step[at, "a" if at == 2 else "u"]
        heapq.heappush(queue, (cost + 2, edits + "I", i, fresh))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, at))
            if not gone:
                if (at, initial) in step:
                    heapq.heappush(queue, (cost + cut, edits + "K", i + 1, step[at, initial]))
                heapq.heappush(queue, (cost + 2 + cut, edits + "R", i + 1, fresh))
    return None


def test_search_finds_the_least_cheapest_edits():
    dice = random.Random(5)
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            rows = [(x, dice.random() < 0.2, dice.random() < 0.3) for x in initials]
            rows = [(x, g, c and not g) for x, g, c in rows]
            assert repair.search(rows) == cheapest(rows), rows
            for entry in range(4):
                for leave in range(4):
                    if n:
                        assert repair.search(rows, entry, leave) == cheapest(rows, entry, leave), (rows, entry, leave)
    for _ in range(300):
        rows = [(dice.choice("suuaa "), dice.random() < 0.15, False) for _ in range(dice.randint(4, 14))]
        assert repair.search(rows) == cheapest(rows), rows


def damage(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        held = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held.extend([(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1))
    return {c: sorted(r) for c, r in out.items()}


def brute(rows):
    wanted = []
    for c, held in damage(rows).items():
        turns = [t for known, t, _, _ in held if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen, plain = [0, 0, 0], set(), []
        for _, _, role, text in held:
            solid = text.rstrip(BREAKS)
            fault = 0 if not text.strip(BREAKS) else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            plain.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in itertools.pairwise(plain))
        cost, edits = cheapest(plain) if plain else (0, "")
        lines, at, place = [], 0, 0
        for e in edits:
            fresh = "assistant" if place == 2 else "user"
            if e == "I":
                lines.append(f"{fresh}:")
                place = 3 if place == 2 else 2
                continue
            _, _, role, text = held[at]
            at += 1
            if e != "D":
                role = role if e == "K" else fresh
                place = {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append(f"{role}:{text}")
        wanted.append((c, gaps, *faults, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(wanted)


FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talk(seed):
    dice = random.Random(seed)
    rows = []
    for c in range(-5, 80):
        for turn in range(dice.choice([1, 2, 4, 6, 9])):
            role = dice.choice(["user", "assistant"]) if dice.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = "system" if turn == 0 and dice.random() < 0.3 else role
            text = dice.choice(["Yes.", "No way!", "open end", "Why? \n", "", " \t", None, "a. b", "Ünï. "])
            rows.append((c, turn if dice.random() < 0.9 else None, None if dice.random() < 0.05 else role, text))
    rows += rows[:20] + [(90, 2**40, "", "x."), (None, 1, "user", "lost."), (91, None, None, None), (92, 7, "user", "long " * 30_000 + ".")]
    rows += [(95, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(150)]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [64, 3])
def test_repairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "PIECE", 40)
    rows = talk(block)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "2 as block", "'x' as kind")
    found = repair.damaged_repairs(frame)
    assert sorted(tuple(r[f] for f in FIELDS) for r in found.collect()) == brute(rows)


def test_repaired_rows_are_legal(spark):
    rows = talk(9)
    found = repair.repaired_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "seq", "nth").collect()
    for _, group in itertools.groupby(found, lambda r: r.conv_id):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in group))


def test_empty_table(spark):
    assert repair.damaged_repairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
