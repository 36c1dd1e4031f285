"""Words of Arrow text batches as arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters per step, so that memory stays bounded whatever a batch of rows holds.
STEP_CHARS = 1_000_000


def slices(texts: pa.Array, chars: int = STEP_CHARS):
    """Yield (first, last) row ranges of about ``chars`` characters each; a longer text is alone in its range."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    first, size = 0, 0
    for row, n in enumerate(sizes):
        if size and size + n > chars:
            yield first, row
            first, size = row, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Split at ASCII white space: word codes in order, the words by code, and offsets (rows + 1) into the codes.

    Null texts count as empty; empty words do not occur.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes, words = np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # before leading or after trailing white space
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return codes, words, offsets


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes that are the same on every machine: a sum over the bytes, each mixed with its place."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    starts, sizes = ends[:-1], np.diff(ends)
    held = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].astype(np.uint64) if data is not None else np.zeros(0, np.uint64)
    place = np.arange(len(held)) - np.repeat(starts - starts[0], sizes)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(held + place.astype(np.uint64) * np.uint64(256)), dtype=np.uint64)))
    return mix(sums[ends[1:] - ends[0]] - sums[starts - ends[0]], 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit numbers (a bijection for each seed)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
