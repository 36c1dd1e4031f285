"""Exact Jaccard join of documents on distinct 5-word shingles, as a blocked sparse product.

The documents by n-grams incidence matrix is multiplied with its transpose in blocks, and only as far as a pair can still reach the
threshold ``t`` (in per cent: ``100 * intersection >= t * union``):

1. **Sets.** Every document becomes the set of its shingle hashes. Equal sets are one node; a hash group of thousands of copies is one
   row of the matrix from here on.
2. **Columns.** Two sets of sizes a and b can only reach ``t`` if they share one of the first ``n - ceil(t n) + 1`` n-grams of each, in an
   order that is the same for all documents. The product runs over these columns only. A first order is by hash, with the most frequent n-grams last. Each column is a list of nodes, cut where sizes
   jump too far for any pair across the jump.
3. **Short lists**, of at most ``SHORT`` nodes, are multiplied at once; the count of each pair is *accumulated* over the columns, and pairs whose count, long columns and rest of both sets cannot
   reach the overlap that their sizes ask for are discarded. Each set has a signature of parities, one bit per member; cells of different parity bound from below how many members two sets do not share,
   which rules out most of the other pairs for an eighth of a byte per member. The sets of the pairs left are intersected.
4. **Long lists** are not multiplied. A pair that meets in none of the short ones lies in one of them, so their nodes are ordered anew: every n-gram of these sets is counted exactly, and
   columns go from the rarest on. N-grams of one set come first and need no column, so a passage that many documents share is a column only of sets that hold little else.
5. **Blocks.** Of these columns a node leads once its place in all of its lists has been reached: first the nodes that stand first in all of them, then the next 32, 64, 128 and so on, so a list has
   no more leaders in a block than that. A block multiplies its leaders with the nodes behind them in all their lists, accumulates and discards as before. Between blocks, linked nodes are joined to components, and
   pairs within one component are no longer multiplied; a list goes once its nodes are one component. So a group of thousands of near copies costs one pass, and yet each pair of
   different components that could link is counted.

Links are never brought to the driver, and components are found by star contraction in Spark.

Defined results: null texts and texts without words are empty and linked with nothing. Rows with a null ``doc_id`` take part in no link and get a null
component. Rows with one ``doc_id`` and different texts are different nodes; repeated rows are one node. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from risemeter.llm.components import components
from risemeter.llm.tables import free_name, saved, saved_by
from risemeter.llm.words import hash_words, mix, slices, split_words

WORDS = 5
PERCENT = 75
#: n-grams in at least this share of all documents are put last. There are at most (mean set size / share) of them, whatever the input.
FREQUENT_SHARE = 0.0005
#: Nodes of a column that are multiplied at once.
SHORT = 32
#: Followers of a leading node whose sets are intersected in one task; a leader with more is dealt to several.
FOLLOWERS = 200
#: Bits of the table that drops sets that nobody asks for before they move.
TABLE_BITS = 1 << 24
#: Nodes of a column multiplied in the second block; each further block is twice as large.
BLOCK = 32
#: Cells of the incidence matrix that leave a task at a time; a longer set is alone in its batch.
CELLS = 100_000


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, last in slices(texts):
        codes, distinct, offsets = split_words(pc.ascii_lower(texts.slice(first, last - first)))
        hashes = hash_words(distinct)[codes]
        n = max(0, len(hashes) - words + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        rolled = mix(rolled, 2)
        for k in range(last - first):
            a, b = offsets[k], offsets[k + 1]
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = np.zeros(1, dtype=np.uint64)
                for h in hashes[a:b]:
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h, 3)
                yield whole
            else:
                yield np.zeros(0, dtype=np.uint64)


def _set_keys(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(mix(found, 11).sum(dtype=np.uint64).view(np.int64)), int(mix(found, 12).sum(dtype=np.uint64).view(np.int64))


def signature(found: np.ndarray) -> bytes:
    """The parity of the set's hashes in each of about as many cells as it has members (a power of two, 64 at least)."""
    cells = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((mix(found, 21) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(one: bytes, two: bytes) -> int:
    """A lower bound of how many members only one of two sets has: cells of different parity, the finer signature folded to the coarser."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _signed(found: np.ndarray) -> pa.Array:
    return pa.array(found.view(np.int64))


def text_key() -> Column:
    """Names the text of a row within rows of the same id."""
    return F.xxhash64(F.col("text"))


def describe(docs: DataFrame, words: int = WORDS, share: float = FREQUENT_SHARE) -> DataFrame:
    """A row (doc_id, text_key, n, k1, k2, sign, grams, counts) per document: size, name and signature of its set.

    ``grams`` and ``counts`` are null there. Each task adds a row without names that lists the n-grams in at least half of ``share`` of
    its own documents (and in two at least); an n-gram in ``share`` of all documents is listed by some task.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        kept, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged(least: float) -> tuple[np.ndarray, np.ndarray]:
            everything, place = np.unique(np.concatenate([kept, *held]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(len(place) - len(counts), np.int64)])
            total = np.bincount(place, weight, minlength=len(everything)).astype(np.int64)
            return everything[total >= least], total[total >= least]

        size = 0
        for b in batches:
            n, k1, k2, sign = [], [], [], []
            for found in shingle_sets(b.column("text"), words):
                n.append(len(found))
                a, c = _set_keys(found)
                k1.append(a)
                k2.append(c)
                sign.append(signature(found))
                held.append(found)
                size += len(found)
                rows += 1
                if size > 1_500_000:  # lossy counting keeps memory bounded: what is dropped was rare in the rows so far
                    kept, counts = merged(max(2, share * rows / 4))
                    held, size = [], 0
            empty = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sign, pa.binary()), empty.cast(pa.list_(pa.int64())), empty.cast(pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "k1", "k2", "sign", "grams", "counts"],
            )
        if rows:
            kept, counts = merged(max(2, share * rows / 2))
            none = pa.nulls(1)
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([kept.view(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "k1", "k2", "sign", "grams", "counts"],
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    return wanted.mapInArrow(measure, "doc_id long, text_key long, n int, k1 long, k2 long, sign binary, grams array<long>, counts array<long>")


def frequent_grams(described: DataFrame, share: float = FREQUENT_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams in about ``share`` of the documents or more, and their counts.

    Their number is at most mean set size / (share / 2), so they may come to the driver and travel with the tasks.
    """
    rows = described.where("n is not null").count()
    listed = described.where("grams is not null").select(F.explode(F.arrays_zip("grams", "counts")).alias("x"))
    total = listed.groupBy(F.col("x.grams").alias("gram")).agg(F.sum("x.counts").alias("count"))
    found = total.where(F.col("count") >= max(2, share * rows / 2)).toArrow()
    grams = np.asarray(found.column("gram").combine_chunks(), dtype=np.int64).view(np.uint64)
    counts = np.asarray(found.column("count").combine_chunks(), dtype=np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order]


def columns(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT, words: int = WORDS, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(gram, k1, n, pos): the n-grams over which the product runs, per set."""
    grams, counts = frequent

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, names, sizes, cells = [], [], [], 0
            for found in shingle_sets(b.column("text"), words):
                if not len(found):
                    continue
                k1, k2 = _set_keys(found)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                    weight = np.where(grams[at] == found, counts[at], 0)
                    found = found[np.argsort(weight, kind="stable")]
                n = len(found)
                out.append(found[: n - (percent * n + 99) // 100 + 1].copy())  # a view would hold the whole set
                names.append(k2 if k1 in clashing else k1)
                sizes.append(n)
                cells += len(out[-1])
                if cells >= CELLS:
                    yield _column_rows(out, names, sizes)
                    out, names, sizes, cells = [], [], [], 0
            if out:
                yield _column_rows(out, names, sizes)

    wanted = docs.where("doc_id is not null and text is not null").select("text")
    return wanted.mapInArrow(prefix, "gram long, k1 long, n int, pos int")


def _column_rows(out: list[np.ndarray], names: list[int], sizes: list[int]) -> pa.RecordBatch:
    each = [len(x) for x in out]
    return pa.RecordBatch.from_arrays(
        [_signed(np.concatenate(out)), pa.array(np.repeat(np.array(names, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(np.concatenate([np.arange(e, dtype=np.int32) for e in each]))],
        ["gram", "k1", "n", "pos"],
    )


def near(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` whose signatures allow the threshold; no pair that reaches it is lost."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    signed = pairs.join(one, "a").join(two, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "sign_a", "sign_b")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("total").to_pylist(), b.column("sign_a").to_pylist(), b.column("sign_b").to_pylist(), strict=True)
            keep = [(100 + percent) * least_difference(x, y) <= (100 - percent) * total for total, x, y in rows]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return signed.mapInArrow(reach, "a long, b long")


def _bit_table(names: DataFrame) -> np.ndarray:
    """A bounded bit table of the nodes ``k1``: it holds all of them, and with many also others."""
    place = F.col("k1").bitwiseAND(F.lit(TABLE_BITS - 1))
    words = names.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(k1 & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    table[np.asarray(found.column("word").combine_chunks())] = np.asarray(found.column("bits").combine_chunks(), dtype=np.int64).view(np.uint64)
    return table


def node_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(node, n, grams): the set of each of ``wanted`` (k1)."""
    bits = _bit_table(wanted)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last in slices(b.column("text"), 1_000_000):
                names, sets = [], []
                for found in shingle_sets(b.column("text").slice(first, last - first), words):
                    if len(found):
                        k1, k2 = _set_keys(found)
                        name = k2 if k1 in clashing else k1
                        at = name % TABLE_BITS
                        if int(bits[at >> 6]) >> (at & 63) & 1:
                            names.append(name)
                            sets.append(found)
                sizes = [len(x) for x in sets]
                grams = _signed(np.concatenate(sets)) if sets else pa.array([], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32()), grams)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), lists], ["node", "n", "grams"])

    rows = docs.where("doc_id is not null and text is not null").select("text").mapInArrow(named, "node long, n int, grams array<long>")
    # Copies within a task are combined before the exchange on the node, which the semi-join then shares.
    return rows.dropDuplicates(["node"]).join(wanted.select(F.col("k1").alias("node")), "node", "left_semi")


def rare_columns(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(gram, k1, n, pos): the n-grams over which the product runs, from the rarest on, per set; those of one set only count as places."""
    cells = sets.select("node", "n", F.explode("grams").alias("gram"))
    counts = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    # An n-gram of very many sets meets one count, so AQE can split it; the list of a set is bounded by the set.
    back = cells.join(counts, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("shared"))
    alone = "n - size(shared)"
    first = back.selectExpr("node", "n", f"{alone} as alone", f"slice(shared, 1, greatest(0, n - ({percent} * n + 99) div 100 + 1 - ({alone}))) as shared")
    return first.select(F.col("node").alias("k1"), "n", "alone", F.posexplode("shared").alias("k", "c")).selectExpr("c.gram as gram", "k1", "n", "cast(alone + k as int) as pos")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, followers: int = FOLLOWERS) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by intersection of the sets (node, n, grams), which are stored by node.

    A leading node's followers are dealt to groups of a bounded size, each of which gets the leader's set.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / followers).alias("groups"))
    dealt = pairs.join(counts, "a").selectExpr("a", "b", "pmod(xxhash64(b), groups) as deal")
    one = dealt.join(sets.selectExpr("node as b", "n as n_b", "grams as grams_b"), "b")
    two = counts.join(sets.selectExpr("node as a", "n as n_a", "grams as grams_a"), "a").selectExpr("a", "n_a", "grams_a", "explode(sequence(0L, groups - 1)) as deal")
    both = one.join(two, ["a", "deal"]).selectExpr("a", "b", "n_a + n_b as total", "size(array_intersect(grams_a, grams_b)) as both")
    return both.where(f"100 * both >= {percent} * (total - both)").select("a", "b")


def overlap_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, share: float = FREQUENT_SHARE, block: int = BLOCK, short: int = SHORT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; the component is its smallest id."""
    described = saved(describe(docs, words, share), "sets")
    rows = described.where("n is not null")
    # A node goes by 64 of the 128 bits of its set's name. Sets that differ in the other 64 only (expected once in 2^65 pairs) go by those.
    twins = rows.where("n > 0").groupBy("k1").agg(F.min("k2").alias("x"), F.max("k2").alias("y")).where("x <> y")
    clashing = frozenset(r.k1 for r in twins.select("k1").collect())
    rows = rows.withColumn("k1", F.when(F.col("k1").isin(*clashing), F.col("k2")).otherwise(F.col("k1"))) if clashing else rows
    first = F.min(F.struct("doc_id", "text_key", "n", "sign")).alias("first")
    nodes = saved(rows.where("n > 0 and doc_id is not null").groupBy(F.col("k1").alias("node")).agg(first).select("node", "first.*"), "nodes")

    lists = saved(_runs(columns(docs, frequent_grams(described, share), percent, words, clashing), percent), "lists")
    long = lists.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > short).select("gram", "run")
    crowded = saved(lists.join(long, ["gram", "run"], "left_semi").groupBy("k1").agg(F.count(F.lit(1)).alias("long")), "crowded")
    few = lists.join(long, ["gram", "run"], "left_anti").join(crowded, "k1", "left").fillna(0, ["long"]).withColumn("lead", F.lit(0))
    early = saved(near(saved(_block(few, 0, 1, percent), "pairs"), nodes, percent), "near")
    wanted = crowded.select("k1").unionByName(early.select(F.explode(F.array("a", "b")).alias("k1"))).distinct()
    sets = saved_by(node_sets(docs, saved(wanted, "wanted"), words, clashing), "node", "sets")
    again = _runs(rare_columns(sets.join(crowded.select(F.col("k1").alias("node")), "node", "left_semi"), percent), percent)
    again = saved(again, "lists")
    shared = saved(again.join(again.groupBy("k1").agg(F.max("place").alias("lead")), "k1").withColumn("long", F.lit(0)), "columns")

    def links(block: DataFrame) -> DataFrame:
        return saved(linked(saved(near(saved(block, "pairs"), nodes, percent), "near"), sets, percent), "links")

    joined = components(saved(linked(early, sets, percent), "links").unionByName(links(_block(shared, 0, 1, percent))))
    after, width = 1, block
    waiting = _unsettled(shared, joined, after)
    while waiting is not None:
        fresh = links(_block(waiting, after, width, percent))
        joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(fresh))
        after, width = after + width, width * 2
        waiting = _unsettled(waiting.drop("root"), joined, after)

    named = nodes.select("node", "doc_id").join(joined, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    smallest = named.select("node", "root").join(least, "root").select("node", "component_id")
    return rows.join(smallest, rows.k1 == smallest.node, "left").select(
        rows.doc_id,
        "text_key",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, rows.doc_id).when(rows.doc_id.isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _runs(listed: DataFrame, percent: int) -> DataFrame:
    """(gram, run, k1, n, pos, place): the columns, cut where sizes jump too far for any pair across the jump; lists of one node are left out.

    One exchange and one sort by n-gram; the windows stream over a list.
    """
    order = Window.partitionBy("gram").orderBy("n", "k1")
    once = listed.withColumn("before", F.lag("k1").over(order)).where("before is null or before <> k1").drop("before")
    jumps = once.withColumn("start", F.expr(f"coalesce(lag(n) over (partition by gram order by n, k1) * 100 < n * {percent}, true)")).withColumn(
        "end", F.expr(f"coalesce(n * 100 < lead(n) over (partition by gram order by n, k1) * {percent}, true)")
    )
    numbered = jumps.where("not (start and end)").withColumn("run", F.sum(F.col("start").cast("int")).over(order))
    places = F.row_number().over(Window.partitionBy("gram", "run").orderBy("n", "k1")) - 1
    return numbered.select("gram", "run", "k1", "n", "pos", places.alias("place"))


def _block(lists: DataFrame, after: int, width: int, percent: int) -> DataFrame:
    """The (a, b) of the nodes that lead from ``after`` to ``after + width`` with later ones, as far as counts, sizes and components allow.

    The leading node a comes before b in the order by size and name that all columns share, so no pair occurs the other way round, and all
    columns of a pair are counted in one block.
    """
    known = "root" in lists.columns
    side = lambda s: [F.col("k1").alias(s), F.col("n").alias(f"n_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("place").alias(f"place_{s}"), F.col("long").alias(f"long_{s}"), F.col("root" if known else "k1").alias(f"root_{s}")]
    left = lists.where(f"lead >= {after} and lead < {after + width}").select("gram", "run", *side("a"))
    right = lists.select("gram", "run", *side("b"))
    # The overlap that the sizes ask for: both sets must have as many members from any shared n-gram on as are still to be found.
    needed = f"(((n_a + n_b) * {percent} + {99 + percent}) div {100 + percent})"
    early = f"pos_a <= n_a - {needed} and pos_b <= n_b - {needed}"
    cells = left.join(right, ["gram", "run"]).where(f"place_a < place_b and root_a <> root_b and n_a * 100 >= n_b * {percent} and {early}")
    counted = cells.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.least(F.max("long_a"), F.max("long_b")).alias("long"))
    # What is not in these columns is in a long one, or stands behind the last of them in both sets.
    return counted.where(f"count + long + least(n_a - 1 - pos_a, n_b - 1 - pos_b) >= {needed}").select("a", "b")


def _unsettled(lists: DataFrame, roots: DataFrame, after: int) -> DataFrame | None:
    """The lists that still hold nodes of several components and unmultiplied pairs, with the root of each node; None if there are none."""
    placed = lists.join(roots, lists.k1 == roots.node, "left").select("gram", "run", "k1", "n", "pos", "place", "lead", "long", F.coalesce("root", "k1").alias("root"))
    mixed = placed.groupBy("gram", "run").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("lead").alias("last"))
    mixed = mixed.where(f"x <> y and last >= {after}").select("gram", "run")
    waiting = saved(placed.join(mixed, ["gram", "run"], "left_semi"), "waiting")
    return waiting if waiting.limit(1).count() else None


def one_per_component(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, one row each, and all rows without an id; the columns of ``docs``.

    Texts move once, to meet the decisions on (id, text).
    """
    found = overlap_components(docs, percent, words)
    id_, key = free_name(docs.columns, "_id"), free_name(docs.columns, "_key")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (text_key() == F.col(key)), "left_anti")
    repeated = found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return _first_rows(kept) if repeated else kept


def _first_rows(kept: DataFrame) -> DataFrame:
    """One row per id that has words, all rows that have no id or no word."""
    columns, place = kept.columns, free_name(kept.columns, "_place")
    apart = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    number = Window.partitionBy("doc_id", F.when(apart, F.monotonically_increasing_id())).orderBy("text")
    return kept.withColumn(place, F.row_number().over(number)).where(F.col(place) == 1).select(*columns)
