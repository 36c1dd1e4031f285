"""Packing by powers of two: every document is cut into pieces of binary length, and equal lengths share a bucket.

A document of n tokens becomes as many pieces of 2,048 tokens as fit, then one piece for each bit of the rest, longest first. Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding: its length is a power of two. Training reads a bucket at a
time, with a batch size that fits its length.

Sequence ids need no shuffle: the bucket fills the high bits and the row's number within its task the low ones, so the sequences of one bucket are a
range of ids. They are unique, as long as the input has fewer than 2**26 partitions.

Defined results: a null text counts as empty; every document ends with the token ``END``, so an empty one is a piece of one token; null ids are kept;
repeated rows are packed each; further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from risemeter.llm.words import slices, split_words

LENGTH = 2048
END = 1
#: Words whose tokens a task remembers; it starts anew when there are more, so that memory stays bounded.
REMEMBERED = 800_000
#: A run of these after a letter is a token group of its own.
MARKS = ".,!$%&#*"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_lengths(n: int, most: int = LENGTH) -> list[int]:
    """Full pieces, then the bits of the rest from the highest."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of ``ids`` at ``starts`` one behind the other, and their new starts and sizes."""
    moved = np.cumsum(sizes, dtype=np.int32) - sizes.astype(np.int32)
    total = int(moved[-1] + sizes[-1]) if len(sizes) else 0
    return ids[np.repeat((starts - moved).astype(np.int32), sizes) + np.arange(total, dtype=np.int32)], moved, sizes.astype(np.int32)


class WordTokens:
    """Token ids of texts, word by word.

    The vocabulary's rules never join tokens over ASCII white space, and a mark behind a letter begins a new group of its own; so
    a text's ids are those of its words, and a word's those of its letters and its marks.
    """

    def __init__(self, path: str, end: int = END, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.remembered = end, remembered
        self._forget()

    def _forget(self) -> None:
        """Only the end token is known, as word 0."""
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.array([self.end], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _encoded(self, parts: list[str]) -> dict[str, list[int]]:
        """The ids of words; lower-case ASCII letters need none of the steps before the merges."""
        merges = self.tokenizer.model.tokenize
        plain = {w: [t.id for t in merges(w)] for w in parts if w.isascii() and w.isalpha() and w.islower()}
        rest = [w for w in parts if w not in plain]
        for k in range(0, len(rest), 5000):
            part = rest[k : k + 5000]
            plain.update(zip(part, (x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return plain

    def _learn(self, words: list[str]) -> None:
        split = []
        for word in words:
            bare = word.rstrip(MARKS) if word[-1:] in MARKS else word
            if bare and len(bare) < len(word) and bare[-1].isascii() and bare[-1].isalpha() and "<|" not in word:
                split.append((bare.lower() if bare.isascii() else bare, word[len(bare) :]))
            else:
                split.append((word, ""))
        of = self._encoded(list({w for pair in split for w in pair}))
        fresh = [of[a] + of[b] if b else of[a] for a, b in split]
        sizes = np.array([len(x) for x in fresh], dtype=np.int64)
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(fresh), "<u4", int(sizes.sum()))))

    def of_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, the end token included."""
        for first, last in slices(texts):
            part = texts.slice(first, last - first)
            if not pc.any(pc.match_substring(part, "<|")).as_py():  # lower case could make a special token of it
                part = pc.ascii_lower(part)
            codes, words, offsets = split_words(part)
            words = words.to_pylist()
            if len(self.known) > self.remembered:
                self._forget()
            if unknown := [w for w in words if w not in self.known]:
                self._learn(unknown)
            places = np.array([0, *map(self.known.__getitem__, words)], dtype=np.int64)
            # The tokens of this part's distinct words side by side: small enough for the processor's cache.
            ids, starts, sizes = _gathered(self.ids, self.starts[places], self.sizes[places])
            own = np.insert(codes.astype(np.int32) + 1, offsets[1:], 0)
            ids, _, sizes = _gathered(ids, starts[own], sizes[own])
            ends = np.cumsum(sizes)
            at = 0
            for stop in ends[offsets[1:] + np.arange(last - first)]:
                yield ids[at:stop]
                at = stop


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_tokens: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and its ``tokens`` if wanted.

    ``path`` is the tokenizer's file, which every executor can read.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["tokens"] * with_tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tokens.of_texts(b.column("text")), strict=True):
                at = 0
                for n in piece_lengths(len(ids), length):
                    piece = ids[at : at + n]
                    rows.append((doc_id, at, n, zlib.crc32(piece.tobytes()), len(ids), n.bit_length() - 1, *[piece] * with_tokens))
                    at += n
                    size += n
                    if with_tokens and size > 1_000_000 or len(rows) > 50_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", tokens array<int>" * with_tokens
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    number = F.shiftleft(F.col("bucket").cast("long"), 59) + F.monotonically_increasing_id()
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *["tokens"] * with_tokens
    )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 5 + [pa.int32()]
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
    if len(columns) > 6:
        sizes = [len(x) for x in columns[6]]
        flat = np.concatenate(columns[6]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat)))
    return pa.RecordBatch.from_arrays(arrays, names)
