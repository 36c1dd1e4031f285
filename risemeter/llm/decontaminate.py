"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are sequences of words (lower case, marks at both ends of a word removed), and distances count inserted, deleted and exchanged words.
A document is contaminated by an item of n words if some passage is at most ``floor(MAX_EDITS * n)`` edits away.

1. **Windows.** An item that allows ``k`` edits is cut into ``k + 1`` pieces; as an edit touches one piece at most, every copy within the limit holds one of
   them unchanged. Each piece is indexed by the window of its first words (at most ``GAP``), so an item's window grows with its length over ``k + 1``.
2. **Embedding.** A CGK random walk reads a window word by word: at each step it writes down the word under its pointer and moves on or stays, by a random bit
   of (word, step); behind the window it reads padding, never the words that follow. The key of a window is the hash of all places of its walk, so equal
   windows always meet and one walk finds every copy, whatever the length of its item.
3. **Documents** offer windows at every word over their whole texts; only those whose first two words begin some window are walked.
4. **Verification.** Each candidate is aligned with the whole item (bit-parallel edit distance) in the same task. Nothing is shuffled.

The benchmark is read in blocks of a bounded number of words, one pass over the documents each, so what travels with a task is bounded.

Defined results: null or empty texts and items without a word match nothing; null item ids and null document ids are reported as they are; repeated
items and repeated documents are reported each; of several passages that match one item the closest (then first) is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from risemeter.llm.words import hash_words, mix, slices, split_words

MAX_EDITS = 0.15
STEPS_PER_WORD = 3
BLOCK_WORDS = 200_000
MARKS = ".,;:!?\"'()[]{}<>|*#$%&~^_-=+/\\@`"
#: A window has at most so many words: an item of n words has more than MAX_EDITS * n pieces.
GAP = int(1 / MAX_EDITS)
FILTER_BITS = 20


def _pieces(n: int) -> tuple[int, list[int]]:
    """Words in a window, and where the windows of an item of n words begin."""
    count = int(MAX_EDITS * n) + 1
    return n // count, [k * n // count for k in range(count)]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and offsets."""
    codes, words, offsets = split_words(pc.utf8_lower(texts))
    bare = pc.utf8_trim(words, characters=MARKS)
    keep = np.asarray(pc.not_equal(bare, ""))[codes] if len(codes) else np.zeros(0, bool)
    return hash_words(bare)[codes][keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of the same words."""
    found = []
    for m in re.finditer(r"[^\x20\x09-\x0d]+", text):
        word = m.group()
        left = len(word) - len(word.lstrip(MARKS))
        if left < len(word):
            found.append((m.start() + left, m.start() + len(word.rstrip(MARKS))))
    return found


def _padded(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with ``GAP`` empty ones behind each text, and where each text begins."""
    rows = len(offsets) - 1
    out = np.zeros(len(hashes) + GAP * rows, dtype=np.uint64)
    out[np.arange(len(hashes)) + GAP * np.repeat(np.arange(rows), np.diff(offsets))] = hashes
    return out, offsets[:-1] + GAP * np.arange(rows)


def first_words(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A small number for the first two words of each window (of one word: for the word)."""
    first = words[starts]
    return (mix(first if window == 1 else first * np.uint64(0x9E3779B97F4A7C15) + words[starts + 1], 7) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def walk_keys(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """One key per start: all places of the CGK walk over the window there."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for first in range(0, len(starts), 1 << 16):
        part = starts[first : first + (1 << 16)]
        read = np.zeros((len(part), window + 1), dtype=np.uint64)
        read[:, :window] = words[part[:, None] + np.arange(window)]
        masks = mix(read, 100)
        rows, at = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
        keys = out[first : first + (1 << 16)]
        for step in range(STEPS_PER_WORD * window):
            now = masks[rows, at]
            keys[:] = (keys ^ now) * np.uint64(0x9E3779B97F4A7C15)
            at = np.minimum(at + ((now >> np.uint64(step + 20)) & np.uint64(1)).astype(np.int64), window)
    return mix(out, 5)


def edit_match(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """(distance, end): the closest passage of ``text`` to ``pattern`` and its first possible end; ``anchored`` ones begin with the text."""
    n = len(pattern)
    masks: dict[int, int] = {}
    for k, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    best, end = n, 0
    for j, word in enumerate(text, 1):
        equal = masks.get(word, 0)
        x = equal | down
        diagonal = ((((x & up) + up) ^ up) | x) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus = (plus << 1 | anchored) & full
        minus = minus << 1 & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        if distance < best:
            best, end = distance, j
    return best, end


@dataclass
class Index:
    """The windows of one block of items."""

    items: list[tuple[int | None, list[int]]]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        pieces = [_pieces(len(words)) for _, words in self.items]
        for window in sorted({size for size, _ in pieces}, reverse=True):
            members = [k for k, (size, _) in enumerate(pieces) if size == window]
            sizes = np.array([len(self.items[k][1]) for k in members])
            words, begins = _padded(np.concatenate([np.array(self.items[k][1], dtype=np.uint64) for k in members]), np.concatenate(([0], np.cumsum(sizes))))
            counts = [len(pieces[k][1]) for k in members]
            offsets = np.concatenate([np.array(pieces[k][1]) for k in members])
            owners, starts = np.repeat(np.array(members), counts), np.repeat(begins, counts) + offsets
            keys = walk_keys(words, starts, window)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, dtype=bool)
            seen[first_words(words, starts, window)] = True
            self.tables[window] = (keys[order], owners[order].astype(np.int32), offsets[order].astype(np.int32), seen)

    def candidates_of(self, window: int, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, word of the text at which the item would begin)."""
        known, owners, offsets, seen = self.tables[window]
        counts = np.maximum(sizes - window + 1, 0)
        rows = np.repeat(np.arange(len(sizes)), counts)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[rows] + at
        hit = np.flatnonzero(seen[first_words(words, starts, window)])
        keys = walk_keys(words, starts[hit], window)
        left, right = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
        found = np.repeat(hit, right - left)
        entries = np.arange(len(found)) - np.repeat(np.cumsum(right - left) - right, right - left)
        return set(zip(rows[found].tolist(), owners[entries].tolist(), (at[found] - offsets[entries]).tolist(), strict=True))

    def candidates(self, words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int, int]]:
        return set().union(*(self.candidates_of(window, words, begins, sizes) for window in self.tables))

    def hits(self, texts: pa.Array) -> list[list[tuple]]:
        """For each text the (item id, distance, words of the item, start, end) of the items in it."""
        out: list[list[tuple]] = []
        for first, last in slices(texts):
            part = texts.slice(first, last - first)
            hashes, offsets = _words(part)
            words, begins = _padded(hashes, offsets)
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for row, item, at in sorted(self.candidates(words, begins, np.diff(offsets))):
                pattern = self.items[item][1]
                allowed = int(MAX_EDITS * len(pattern))
                known = found.get((row, item))
                if known and known[0] == 0:
                    continue
                own = hashes[offsets[row] : offsets[row + 1]]
                low, high = max(0, at - allowed), max(0, at + len(pattern) + 2 * allowed)
                distance, end = edit_match(pattern, own[low:high].tolist())
                if distance <= allowed and end and (not known or (distance, low + end) < (known[0], known[2])):
                    _, back = edit_match(pattern[::-1], own[low : low + end][::-1].tolist(), anchored=True)
                    found[row, item] = (distance, low + end - back, low + end)
            rows: dict[int, list[tuple]] = {}
            for (row, item), (distance, start, end) in found.items():
                rows.setdefault(row, []).append((item, distance, start, end))
            for row in range(last - first):
                if row not in rows:
                    out.append([])
                    continue
                places = _places(part[row].as_py())
                out.append([(self.items[i][0], d, len(self.items[i][1]), places[a][0], places[b - 1][1]) for i, d, a, b in sorted(rows[row])])
        return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, list[int]]]]:
    """The items, at most about ``block_words`` words at a time."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", (F.size(F.split("text", r"\s+"))).cast("long").alias("size")).where("text is not null")
    total = sized.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // block_words)
    placed = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    for block in range(blocks):
        table = placed.where(F.col("block") == block).select("item_id", "text").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        hashes, offsets = _words(table.column("text").combine_chunks())
        items = [(i, hashes[offsets[k] : offsets[k + 1]].tolist()) for k, i in enumerate(table.column("item_id").to_pylist())]
        yield sorted(((i, w) for i, w in items if w), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    return (Index(items) for items in item_blocks(benchmark) if items)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, end) of every document and item in it; documents without items have no row."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance int, item_words int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *hit) for i, hits in zip(b.column("doc_id").to_pylist(), index.hits(b.column("text")), strict=True) for hit in hits]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(list(zip(["doc_id", "item_id", "distance", "item_words", "start", "end"], kinds, strict=True))))

        out = out.unionByName(wanted.mapInArrow(search, schema))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item occurs."""
    at = docs.columns.index("text")
    for index in indexes(benchmark):

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not hits for hits in index.hits(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
