"""Prefix trie of conversations as a z-fast trie, built in batches.

A node of the trie is a distinct sequence of first turns. Sequences are compared by prefix hashes of 128 bits: the exclusive or over the turns so
far of a hash of the turn and its place.

1. **Strings.** Each conversation is cut into strings of at most ``STRING`` turns; a string starts where the one before it ends, so a prefix hash
   names everything before it and each string is looked up for itself, however long its conversation is. Equal strings are one string.
2. **Compacted nodes.** A compacted node has an edge: the depths ``low < d <= high`` between its parent's end and its own, along which nothing
   branches and no string ends. The table of nodes is hashed twice: by the *handle*, the prefix at the two-fattest depth of (low, high] (the one
   that the highest power of two divides), and by the first prefix of the edge.
3. **Exit nodes.** Each pending string halves its depths by fat binary search: it probes the handles with its prefix at the two-fattest depth of what
   is left, jumps to the end of the node it finds, or cuts off what is deeper. One join by handle per step, for all strings at once; steps grow with the
   logarithm of the length. The first prefix of an edge then gives the exit node, and the hashes on its edge the exit depth.
4. **Batches.** All cuts of edges are made at once. Strings that leave the trie at the same place with the same next turn are one group: the string with
   the smallest hash enters with the rest of its turns as a new edge, the others wait. A group falls to a random part of itself, so the number of
   batches is logarithmic.
5. **Subtrees.** Conversations, smallest members, leaves and words are summed up to all ancestors by pointer doubling over the compacted nodes.
6. **Edges** are expanded at the end: each depth of an edge is a node with the members of the edge's end.

Defined results: null roles and texts are empty; rows with a null ``conv_id`` take no part; rows of one conversation with the same turn are ordered by role and text,
repeated rows are turns of their own. A conversation that is rebuilt without turns ends in the root. An empty table gives no node. A text of any length
counts as one hash and a number of words. Further columns are not read. The digest of one node's members passes one task, in chunks of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from risemeter.llm.ordering import digests, in_order
from risemeter.llm.tables import saved
from risemeter.llm.words import mix

#: Turns of a string, which bounds a row.
STRING = 1024
#: Ids joined into one row of a digest.
IDS = 4096
#: Conversations share the beginning of the first of so many ids.
GROUP = 20

_WORD_BREAK = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")).cast("long")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, hx, hy, words): the turns of each conversation in order, places from 1. Texts move once, for the order; hashes go on."""
    wanted = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    hashed = in_order(wanted, ["conv_id", "turn", "role", "text"]).select(
        "conv_id", "seq", F.xxhash64("role", "text").alias("hx"), F.xxhash64(F.lit("turn"), "text", "role").alias("hy"), word_count(F.col("text")).alias("words")
    )
    ordered = saved(hashed, "turns")
    # Where each conversation starts in each partition it touches, and how many of its turns lie in earlier ones.
    part = F.shiftright("seq", 33).alias("part")
    starts = ordered.groupBy("conv_id", part).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("conv_id", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return ordered.withColumn("part", F.shiftright("seq", 33)).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("seq") + F.col("shift")).alias("place"), "hx", "hy", "words")


def rebuilt(turns: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, depth, hx, hy, words) of the rebuilt conversations, and all conversation ids.

    The first h turns come from the first conversation of the group, if there is one, and then the conversation's own after its first h.
    """
    base, head = F.col("conv_id") - F.col("conv_id") % group, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    heads = turns.where((base == F.col("conv_id")) & (F.col("place") <= 3)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("place", "hx", "hy", "words"))).alias("head"))
    ids = turns.select("conv_id").distinct()
    plan = ids.select("conv_id", base.alias("base"), head.cast("int").alias("h")).join(heads, "base", "left")
    plan = plan.select("conv_id", "h", F.coalesce(F.expr("slice(head, 1, h)"), F.array().cast("array<struct<place:bigint,hx:bigint,hy:bigint,words:bigint>>")).alias("head"))
    taken = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.hx", "t.hy", "t.words")
    rest = turns.where(F.col("place") > head).join(plan.select("conv_id", (F.size("head") - F.col("h")).alias("shift")), "conv_id")
    rest = rest.select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "hx", "hy", "words")
    return taken.unionByName(rest), ids


def _strings(turns: DataFrame, length: int) -> DataFrame:
    """(conv_id, low, high, px, py, c0, x, y, c): the strings of each conversation; prefix hashes x, y and words so far c at each depth, and those before it."""
    part = F.floor((F.col("depth") - 1) / length).cast("long").alias("part")
    rows = turns.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("depth", "hx", "hy", "words"))).alias("t"))
    rows = rows.select("conv_id", "part", F.col("t.depth").alias("depth"), F.col("t.hx").alias("hx"), F.col("t.hy").alias("hy"), F.col("t.words").alias("words"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = np.asarray(b.column("depth").offsets, dtype=np.int64)
            flat = {n: np.asarray(b.column(n).flatten(), dtype=np.int64) for n in ("depth", "hx", "hy", "words")}
            offsets = offsets - offsets[0]
            place = flat["depth"].view(np.uint64)
            starts, sizes = offsets[:-1], np.diff(offsets)
            lists = []
            for name, seed in (("hx", 31), ("hy", 33)):
                run = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(mix(flat[name].view(np.uint64) ^ mix(place, seed), seed + 1))))
                lists.append((run[1:] ^ np.repeat(run[starts], sizes)).view(np.int64))
            run = np.concatenate(([0], np.cumsum(flat["words"])))
            lists.append(run[1:] - np.repeat(run[starts], sizes))
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v)) for v in lists]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), *columns], ["conv_id", "part", "x", "y", "c"])

    local = rows.mapInArrow(prefixes, "conv_id long, part long, x array<long>, y array<long>, c array<long>")
    local = saved(local.withColumn("low", F.col("part") * length).withColumn("high", F.col("low") + F.size("x")), "strings")
    # What the strings before one add; there is one row per string here, and only of conversations that have several.
    totals = local.select("conv_id", "part", F.element_at("x", -1).alias("tx"), F.element_at("y", -1).alias("ty"), F.element_at("c", -1).alias("tc"))
    totals = totals.join(totals.where("part > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "part", F.bit_xor("tx").over(before).alias("px"), F.bit_xor("ty").over(before).alias("py"), F.sum("tc").over(before).alias("c0"))
    known = local.join(offsets.where("part > 0"), ["conv_id", "part"], "left").fillna(0, ["px", "py", "c0"])
    return known.select(
        "conv_id", "low", "high", "px", "py", "c0",
        F.transform("x", lambda v: v.bitwiseXOR(F.col("px"))).alias("x"),
        F.transform("y", lambda v: v.bitwiseXOR(F.col("py"))).alias("y"),
        F.transform("c", lambda v: v + F.col("c0")).alias("c"),
    )


def _fattest(a: str, b: str) -> str:
    """The number in (a, b] that the highest power of two divides."""
    return f"({b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1))"


_NODE = ["low", "high", "px", "py", "c0", "x", "y", "c"]


def _located(pending: DataFrame, nodes: DataFrame | None, steps: int) -> DataFrame:
    """``pending`` with the exit depth q, and the exit node (gx, gy) with its end where q lies before that (else the end is null)."""
    found = pending.withColumns({"a": F.col("low"), "b": F.col("high")})
    if nodes is None:
        return found.selectExpr(*pending.columns, "low as q", "cast(null as long) as nx", "cast(null as long) as ny", "cast(null as long) as end")
    fat = _fattest("low", "high")
    handles = nodes.selectExpr(f"element_at(x, cast({fat} - low as int)) as fx", f"element_at(y, cast({fat} - low as int)) as fy", "low as n_low", "high as n_high", "element_at(x, -1) as ex", "element_at(y, -1) as ey")
    for _ in range(steps):
        f = _fattest("a", "b")
        # A string that is done probes with its own hash, so that such rows stay spread.
        probe = found.selectExpr("*", f"if(a < b, {f}, high) as f").selectExpr("*", "element_at(x, cast(f - low as int)) as fx", "element_at(y, cast(f - low as int)) as fy")
        hit = probe.join(handles, ["fx", "fy"], "left").selectExpr(
            *pending.columns, "a", "b", "f", "n_low", "n_high", "a < b and n_high is not null as hit",
            "coalesce(n_high <= high and try_element_at(x, cast(n_high - low as int)) = ex and try_element_at(y, cast(n_high - low as int)) = ey, false) as whole",
        )
        found = hit.selectExpr(
            *pending.columns, "case when not hit then a when whole then n_high else n_low end as a",
            "case when hit and whole then b when hit then n_low when a < b then f - 1 else b end as b",
        )
    edges = nodes.selectExpr("element_at(x, 1) as nx", "element_at(y, 1) as ny", "high as end", "x as edge_x", "y as edge_y")
    next_ = found.selectExpr("*", "element_at(x, cast(if(a < high, a + 1, high) - low as int)) as nx", "element_at(y, cast(if(a < high, a + 1, high) - low as int)) as ny")
    met = next_.join(edges, ["nx", "ny"], "left").selectExpr("*", "a < high and end is not null as met", "cast(least(end, high) - a as int) as m")
    same = lambda s: f"size(filter(zip_with(slice({s}, cast(a - low + 1 as int), m), slice(edge_{s}, 1, m), (u, v) -> u = v), e -> e))"
    placed = met.selectExpr(*pending.columns, "nx", "ny", "end", "met", f"if(met, a + least({same('x')}, {same('y')}), a) as q")
    return placed.selectExpr(*pending.columns, "q", *(f"if(met and q < end, {c}, null) as {c}" for c in ("nx", "ny", "end")))


def _inserted(nodes: DataFrame | None, located: DataFrame, marked: DataFrame) -> DataFrame:
    """The nodes after all edges are cut where strings left or ended, and the first string of each group has entered."""
    left = marked.where("sx = first_x and sy = first_y").selectExpr(
        "q as low", "high", "if(q = low, px, x[q - low - 1]) as px", "if(q = low, py, y[q - low - 1]) as py", "if(q = low, c0, c[q - low - 1]) as c0",
        *(f"slice({s}, cast(q - low + 1 as int), cast(high - q as int)) as {s}" for s in "xyc"),
    )
    if nodes is None:
        return left
    cuts = located.where("end is not null").groupBy("nx", "ny").agg(F.collect_set("q").alias("cuts"))
    keyed = nodes.selectExpr("*", "element_at(x, 1) as nx", "element_at(y, 1) as ny").join(cuts, ["nx", "ny"], "left")
    bounds = keyed.selectExpr(*_NODE, "if(cuts is null, array(low, high), array_sort(concat(array(low, high), cuts))) as d")
    pieces = bounds.selectExpr(*_NODE, "d", "explode(sequence(1, size(d) - 1)) as k").selectExpr("* except (d, k)", "d[k - 1] as l", "d[k] as h")
    cut = pieces.selectExpr(
        "l as low", "h as high", "if(l = low, px, x[l - low - 1]) as px", "if(l = low, py, y[l - low - 1]) as py", "if(l = low, c0, c[l - low - 1]) as c0",
        *(f"slice({s}, cast(l - low + 1 as int), cast(h - l as int)) as {s}" for s in "xyc"),
    )
    return cut.unionByName(left)


def z_fast_nodes(strings: DataFrame) -> DataFrame:
    """The compacted nodes (low, high, px, py, c0, x, y, c) of all strings."""
    keyed = strings.selectExpr(*_NODE, "element_at(x, -1) as sx", "element_at(y, -1) as sy")
    pending = saved(keyed.dropDuplicates(["sx", "sy"]), "pending")
    longest = pending.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    # Each step clears the highest bit in which the two ends of the search differ; a start that is not 0 can cost one more.
    steps = int(longest or 0).bit_length() + int(pending.where("low > 0").limit(1).count())
    nodes = None
    while longest and (nodes is None or pending.limit(1).count()):
        located = saved(_located(pending, nodes, steps), "located")
        leaving = located.where("q < high").selectExpr("*", "x[q - low] as gx", "y[q - low] as gy")
        first = leaving.groupBy("gx", "gy").agg(F.min(F.struct("sx", "sy")).alias("first")).selectExpr("gx", "gy", "first.sx as first_x", "first.sy as first_y")
        marked = saved(leaving.join(first, ["gx", "gy"]), "marked")
        nodes = saved(_inserted(nodes, located, marked), "nodes")
        pending = marked.where("not (sx = first_x and sy = first_y)").select(*pending.columns)
    return nodes if nodes is not None else strings.select(*_NODE).limit(0)


def _summed(values: DataFrame) -> DataFrame:
    """Add up to all ancestors: in round k each node gives what it holds to its ancestor 2^k nodes above."""
    held = saved(values, "held")
    while held.where("jx is not null").limit(1).count():
        given = held.where("jx is not null").groupBy(F.col("jx").alias("ex"), F.col("jy").alias("ey"))
        given = given.agg(F.sum("n").alias("n_"), F.min("least").alias("least_"), F.sum("cum").alias("cum_"), F.sum("words").alias("words_"), F.sum("leaves").alias("leaves_"))
        above = held.selectExpr("ex as kx", "ey as ky", "jx as jjx", "jy as jjy")
        # A node that has jumped past the root looks itself up, so that such nodes stay spread.
        joined = held.join(given, ["ex", "ey"], "left").selectExpr("*", "coalesce(jx, ex) as kx", "coalesce(jy, ey) as ky").join(above, ["kx", "ky"])
        held = saved(
            joined.selectExpr(
                "ex", "ey", "if(jx is null, null, jjx) as jx", "if(jy is null, null, jjy) as jy", "n + coalesce(n_, 0) as n", "least(least, least_) as least",
                "cum + coalesce(cum_, 0) as cum", "words + coalesce(words_, 0) as words", "leaves + coalesce(leaves_, 0) as leaves",
            ),
            "held",
        )
    return held


def _end_digests(ends: DataFrame) -> DataFrame:
    """(ex, ey, sha256) of the ascending ids, comma-joined, of the conversations that end in a node; a few thousand ids travel as one row."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, first = None, [], True
        out: list[tuple] = []
        for b in batches:
            for x, y, c in zip(*(b.column(n).to_pylist() for n in ("ex", "ey", "conv_id")), strict=True):
                if key != (x, y) or len(ids) == IDS:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (x, y), []
                ids.append(c)
            if len(out) >= 1000 or sum(len(o[3]) for o in out) > 1 << 20:
                yield _rows(out)
                out = []
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        if out:
            yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["ex", "ey", "at", "text"])

    dealt = ends.select("ex", "ey", "conv_id").repartitionByRange("ex", "ey", "conv_id").sortWithinPartitions("ex", "ey", "conv_id")
    pieces = dealt.mapInArrow(join, "ex long, ey long, at long, text string")
    return digests(pieces, ["ex", "ey"], "at", between=b",")


def prefix_trie(turns: DataFrame, ids: DataFrame, length: int = STRING) -> DataFrame:
    """The nodes of the trie over turns (conv_id, depth, hx, hy, words), depths from 1 without gaps, and conversations ``ids`` (conv_id), turnless ones included.

    Gives (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); a node's turns are the first ``depth`` of ``conv_id``.
    """
    strings = saved(_strings(turns, length), "strings")
    nodes = z_fast_nodes(strings)
    last = strings.groupBy("conv_id").agg(F.max(F.struct("high", F.element_at("x", -1).alias("ex"), F.element_at("y", -1).alias("ey"), F.element_at("c", -1).alias("cum"))).alias("e"))
    ends = ids.join(last, "conv_id", "left").selectExpr("conv_id", "coalesce(e.ex, 0) as ex", "coalesce(e.ey, 0) as ey", "coalesce(e.cum, 0) as cum")
    ends = saved(ends, "ends")
    ending = ends.groupBy("ex", "ey").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sum("cum").alias("cum"))

    children = nodes.groupBy(F.col("px").alias("ex"), F.col("py").alias("ey")).agg(F.count(F.lit(1)).alias("n_children"))
    root = ids.limit(1).selectExpr("0L as ex", "0L as ey", "cast(null as long) as jx", "cast(null as long) as jy", "0L as words")
    all_ = nodes.selectExpr("element_at(x, -1) as ex", "element_at(y, -1) as ey", "px as jx", "py as jy", "element_at(c, -1) - c0 as words").unionByName(root)
    values = all_.join(ending, ["ex", "ey"], "left").join(children, ["ex", "ey"], "left")
    values = values.selectExpr("ex", "ey", "jx", "jy", "coalesce(n, 0) as n", "least", "coalesce(cum, 0) as cum", "words", "if(n_children is null, 1L, 0L) as leaves")
    total = _summed(values).drop("jx", "jy")

    above = total.selectExpr("ex as px", "ey as py", "least as above")
    edges = nodes.withColumns({"ex": F.element_at("x", -1), "ey": F.element_at("y", -1)}).drop("x", "y").unionByName(
        ids.limit(1).selectExpr("-1L as low", "0L as high", "cast(null as long) as px", "cast(null as long) as py", "0L as c0", "array(0L) as c", "0L as ex", "0L as ey")
    )
    full = edges.join(total, ["ex", "ey"]).join(above, ["px", "py"], "left").join(children, ["ex", "ey"], "left").join(_end_digests(ends), ["ex", "ey"], "left")
    each = full.select("*", F.posexplode("c").alias("k", "_")).withColumn("before", F.expr("if(k = 0, c0, c[k - 1])"))
    return each.selectExpr(
        "least as conv_id", "low + k + 1 as depth", "if(k = 0, above, least) as parent_conv_id", "n as n_convs",
        "if(low + k + 1 < high, 1L, coalesce(n_children, 0L)) as n_children", "leaves as n_leaves",
        "cum - n * before - (words - (before - c0)) as saved_tokens",
        "if(low + k + 1 = high, coalesce(sha256, sha2(cast('' as binary), 256)), sha2(cast('' as binary), 256)) as ends_sha256",
    )


def conversation_trie(conversations: DataFrame, length: int = STRING) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text)."""
    turns, ids = rebuilt(saved(turn_rows(conversations), "placed"))
    return prefix_trie(turns, ids, length)
