"""Hashes of the n-grams of texts, by one rolling pass over the code points of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

# Fixed value: code points hashed at a time. The passes over so many stay in a core's cache, and it bounds the memory of a task whatever the texts.
SLICE = 1 << 16

# Places of the table that is asked first, the bit table folded to what a core's cache holds.
FOLDED = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def _rolled(points: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rolling value of the n-gram at each place), each length from the one before, in the same array."""
    one = (points.astype(np.uint64) + np.uint64(1)) * _BASE
    one ^= one >> np.uint64(29)
    one *= _ODD
    rolled = one.copy()
    for n in range(1, min(max(lengths, default=0), len(points)) + 1):
        if n > 1:
            rolled = rolled[:-1]
            rolled *= _BASE
            rolled += one[n - 1 :]
        if n in lengths:
            yield n, rolled


def _finished(rolled: np.ndarray) -> np.ndarray:
    hashed = rolled * _ODD
    hashed ^= hashed >> np.uint64(32)
    return hashed


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def _starts(points: np.ndarray) -> np.ndarray:
    """The byte of the UTF-8 form at which each code point begins, and the byte after the last."""
    if not len(points) or points.max() < 0x80:
        return np.arange(len(points) + 1)
    return np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))


def _slice_hashes(rows: list[int], firsts: list[int], texts: list[str], lengths: list[int], bits: np.ndarray | None, few: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Row, hash and byte place of the n-grams of each text of a slice that the bit table holds; a text begins at its first byte."""
    ends = np.cumsum([len(t) for t in texts])
    points = _points(texts)
    owner, starts = np.asarray(rows, dtype=np.int64), _starts(points)
    moved = np.asarray(firsts, dtype=np.int64) - starts[np.concatenate(([0], ends[:-1]))]
    found = []
    for n, rolled in _rolled(points, lengths):
        hashed = _finished(rolled)
        if bits is None:
            place = np.arange(len(hashed))
        else:
            place = np.flatnonzero(few.take((hashed & np.uint64(len(few) - 1)).view(np.int64)))
            place = place[bits[(hashed[place] & np.uint64(len(bits) - 1)).view(np.int64)]]
        text = np.searchsorted(ends, place, side="right")
        inside = place + n <= ends[text]  # an n-gram ends in the text where it begins
        place, text = place[inside], text[inside]
        found.append((owner[text], hashed[place], starts[place] + moved[text]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def text_places(texts: list[str | None], lengths: list[int], words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, only those that the bit table holds if there is one, and for each the byte of
    the text's UTF-8 form at which one of its n-grams begins; first, where each text's own begin, and their number."""
    parts, rows, firsts, pieces, size = [], [], [], [], 0
    bits = None if words is None else np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little").view(bool)
    few = None if bits is None else bits.reshape(-1, min(len(bits), FOLDED)).any(axis=0)
    overlap = max(lengths, default=1) - 1

    def flush() -> None:
        parts.append(_slice_hashes(rows, firsts, pieces, lengths, bits, few))

    for k, whole in enumerate(texts):
        first = 0
        for start in range(0, len(whole or ""), SLICE):
            piece = whole[start : start + SLICE + overlap]
            rows.append(k)
            firsts.append(first)
            pieces.append(piece)
            first += len(piece[:SLICE].encode())
            size += len(piece)
            if size >= SLICE:
                flush()
                rows, firsts, pieces, size = [], [], [], 0
    if pieces:
        flush()
    if not parts:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    row, hashed, place = (np.concatenate(part) for part in zip(*parts, strict=True))
    order = np.lexsort((hashed, row))
    row, hashed, place = row[order], hashed[order], place[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return np.searchsorted(row[new], np.arange(len(texts) + 1)), hashed[new].view(np.int64), place[new]


def text_hashes(texts: list[str | None], lengths: list[int], words: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, only those that the bit table holds if there is one."""
    firsts, hashed, _ = text_places(texts, lengths, words)
    return np.split(hashed, firsts[1:-1]) if len(texts) else []


def with_gram_hashes(rows: DataFrame, text: str, lengths: list[int], words: np.ndarray | None = None) -> DataFrame:
    """Add ``offered``, the distinct hashes of the n-grams of a text, and ``places``, a byte at which each begins. ``words`` is a bit table as unsigned longs."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts, grams, places = text_places(b.column(text).to_pylist(), lengths, words)
            lists = [pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(x)) for x in (grams, places.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "offered", "places"])

    added = [StructField("offered", ArrayType(LongType())), StructField("places", ArrayType(IntegerType()))]
    return rows.mapInArrow(hashed, StructType([*rows.schema.fields, *added]))


def whole_hash(gram: Column) -> Column:
    """Hash of a string that is itself one n-gram."""

    @F.pandas_udf(LongType())
    def hashed(grams: pd.Series) -> pd.Series:
        return pd.Series([int(text_hashes([g], [len(g)])[0][0]) for g in grams], index=grams.index, dtype="int64")

    return hashed(gram)
