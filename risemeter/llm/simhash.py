"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints (64 bits) link at ``RADIUS`` or fewer differing bits. Every bit i gets a vector of radius + 1 bits; each of the 2^(radius + 1) - 1 nonzero vectors v gives a table, whose key is
the fingerprint on the bits whose vector has an odd product with v. The vectors of at most ``radius`` differing bits leave some v at right angles to all of them, so every pair within the radius
agrees in some table: the covering is complete, not likely.

1. **Nodes** are distinct fingerprints; a group of copies is one node.
2. **Tables.** Nodes are keyed in all tables. Keys with one node are dropped; those of at most ``BUCKET`` nodes are compared in full, which is linear in the nodes.
3. **Full buckets** are not multiplied. Their nodes are sorted by fingerprint, by ranges, so that a bucket of any size is spread, and each is compared with the few before it: in a dense group that joins
   nearly all. Once components are known, a full bucket that is one component is done; in others the largest component is held against the nodes outside it, if they are at most ``BUCKET``.
4. **Finer tables.** A full bucket with more nodes outside is covered again: a pair in it agrees on its key, so the same argument on the remaining bits gives tables with about half of them in
   addition. At most ``2^free`` nodes share a key with ``free`` bits left, so this ends with buckets that are compared in full, and no pair within the radius is lost on the way, but for pairs
   whose nodes are in one component already.

Defined results: null and empty texts, and those without words, have fingerprint zero and link like any other. Rows with a null ``doc_id`` take part in no link and get a null component. Rows with one id and
different texts are rows of their own. Long texts are hashed in runs of words. Further columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from risemeter.llm.components import components
from risemeter.llm.tables import saved
from risemeter.llm.words import slices

WORDS = 3
RADIUS = 3
BITS = 64
SEED = 42
#: Nodes of a key that are compared in full.
BUCKET = 64
#: Nodes before it with which a node of a full bucket is compared at first.
NEIGHBOURS = 8
#: Characters and words hashed at a time.
STEP_CHARS = 1_000_000
STEP_WORDS = 50_000


def fingerprint(words: list[bytes], size: int = WORDS) -> int:
    """The SimHash of a text's words, as a signed number."""
    if not words:
        return 0
    ones, total = np.zeros(BITS, np.int64), 0
    for first in range(0, max(1, len(words) - size + 1), STEP_WORDS):
        part = words[first : first + STEP_WORDS + size - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if len(part) >= size else [b" ".join(part)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(run, SEED) for run in runs), dtype=np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column("text"), []
            for first, last in slices(texts, STEP_CHARS):
                for text in pc.ascii_lower(pc.fill_null(texts.slice(first, last - first), "")):
                    found.append(fingerprint(text.as_buffer().to_pybytes().split(), size))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


def masks(free: int = -1, radius: int = RADIUS) -> list[int]:
    """Sets of the ``free`` bits (all, by default) of which each pair that differs in at most ``radius`` of them agrees on one."""
    bits = [i for i in range(BITS) if free >> i & 1]
    # Unit vectors come first: more than ``radius`` bits span all vectors, so every table then adds a bit at least.
    vectors = sorted(range(1, 2 ** (radius + 1)), key=lambda v: (v.bit_count(), v))
    given = dict(zip(bits, itertools.cycle(vectors), strict=False))
    return [sum(1 << i for i in bits if (given[i] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _keyed(nodes: DataFrame, levels: int, radius: int) -> DataFrame:
    """(fp, mask, key): the nodes, or the nodes of buckets (fp, mask), in all tables of the next level; ``mask`` holds the key's bits."""
    if levels == 0:
        tables = [_signed(m) for m in masks(-1, radius)]
        each = nodes.withColumn("mask", F.explode(F.array(*map(F.lit, tables))))
    else:
        # The bits that the bucket's key leaves free are numbered anew, and covered by the same vectors.
        def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, np.ndarray] = {}
            for b in batches:
                for row in range(0, b.num_rows, 4096):
                    held = b.slice(row, 4096)
                    fps, given = (np.asarray(held.column(c), dtype=np.int64) for c in ("fp", "mask"))
                    for m in np.unique(given).tolist():
                        if m not in known:
                            fixed = m % 2**64
                            known[m] = np.array([_signed(fixed | x) for x in masks(~fixed % 2**64, radius)], np.int64)
                    tables = np.stack([known[m] for m in given.tolist()]) if len(given) else np.zeros((0, 1), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps, tables.shape[1])), pa.array(tables.ravel())], ["fp", "mask"])

        each = nodes.select("fp", "mask").mapInArrow(finer, "fp long, mask long").distinct()
    return each.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _pairs(found: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """The linked pairs of a few fingerprints, each of them compared with the ones before it."""
    differ = np.bitwise_count((found[:, None] ^ found[None, :]).view(np.uint64))
    a, b = np.nonzero(np.tril(differ <= radius, -1))
    return zip(found[a].tolist(), found[b].tolist(), strict=True)


def _link_rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _small(rows: DataFrame, radius: int) -> DataFrame:
    """The links within buckets of at most ``BUCKET`` nodes."""
    lists = rows.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = np.asarray(b.column("fps").offsets), np.asarray(b.column("fps").values, dtype=np.int64)
            links = []
            for k in range(b.num_rows):
                links.extend(_pairs(flat[offsets[k] : offsets[k + 1]], radius))
                if len(links) > 50_000:
                    yield _link_rows(links)
                    links = []
            yield _link_rows(links)

    return lists.mapInArrow(link, "a long, b long").distinct()


def _neighbours(full: DataFrame, radius: int, width: int) -> DataFrame:
    """Links of nodes in full buckets with the ``width`` nodes before them; buckets are spread by ranges of fingerprints."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros((3, 0), np.int64)
        for b in batches:
            now = np.stack([np.asarray(b.column(c), dtype=np.int64) for c in ("mask", "key", "fp")])
            joined = np.concatenate((before, now), axis=1)
            found = []
            for k in range(1, min(width, joined.shape[1] - 1) + 1):
                one, two = joined[:, k:], joined[:, :-k]
                near = (one[0] == two[0]) & (one[1] == two[1]) & (np.bitwise_count((one[2] ^ two[2]).view(np.uint64)) <= radius)
                found.append(np.stack((one[2][near], two[2][near])))
            if found:
                links = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])
            before = joined[:, -width:]

    dealt = full.select("mask", "key", "fp").repartitionByRange("mask", "key", "fp").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def _rooted(full: DataFrame, roots: DataFrame) -> DataFrame:
    """``full`` with each node's component and the largest component of its bucket, without buckets that are one component."""
    named = full.select("mask", "key", "fp").join(roots, full.fp == roots.node, "left").select("mask", "key", "fp", F.coalesce("root", "fp").alias("root"))
    named = saved(named, "rooted")
    shares = named.groupBy("mask", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = shares.groupBy("mask", "key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    mixed = largest.where("m.n < all").selectExpr("mask", "key", "m.root as most", "all - m.n as others")
    return saved(named.join(mixed, ["mask", "key"]), "mixed")


def _held_against(mixed: DataFrame, radius: int) -> DataFrame:
    """Links of all nodes of a bucket with the few outside its largest component."""
    outside = mixed.where("root <> most").groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "root")).alias("few"))
    rows = mixed.select("mask", "key", "fp", "root").join(outside, ["mask", "key"])
    near = F.filter("few", lambda s: (F.bit_count(s.fp.bitwiseXOR(F.col("fp"))) <= radius) & (s.root != F.col("root")))
    return rows.select("fp", F.explode(near).alias("s")).select(F.col("fp").alias("a"), F.col("s.fp").alias("b")).distinct()


def covering_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, width: int = NEIGHBOURS) -> DataFrame:
    """(node, root) of the fingerprints (fp) that link with another; the root is the smallest of the component."""
    joined, held = None, nodes
    for level in itertools.count():
        keyed = _keyed(held, level, radius)
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = saved(keyed.join(sizes, ["mask", "key"]), "shared")
        links = [_small(shared.where(F.col("n") <= bucket), radius)]
        if joined is not None:
            links.append(joined.selectExpr("node as a", "root as b"))
        full = shared.where(F.col("n") > bucket)
        crowded = full.limit(1).count() > 0
        if crowded:
            links.append(_neighbours(full, radius, width))
        joined = components(_union(links))
        if not crowded:
            return joined
        mixed = _rooted(full, joined)
        if not mixed.limit(1).count():
            return joined
        joined = components(_union([joined.selectExpr("node as a", "root as b"), _held_against(mixed.where(F.col("others") <= bucket), radius)]))
        held = mixed.where(F.col("others") > bucket)
        if not held.limit(1).count():
            return joined


def _union(links: list[DataFrame]) -> DataFrame:
    total = links[0]
    for more in links[1:]:
        total = total.unionByName(more)
    return total


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, bucket: int = BUCKET, width: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is the smallest id reachable."""
    rows = saved(fingerprints(docs, words), "fingerprints")
    nodes = saved(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = covering_links(nodes.select("fp"), radius, bucket, width)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    # A third of all rows may have one fingerprint: rows meet one row per fingerprint, so AQE can split them.
    joined = rows.join(placed, "fp", "left")
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
