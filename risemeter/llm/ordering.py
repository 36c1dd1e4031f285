"""Total orders over rows of any skew, and digests of long row sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from risemeter.llm.tables import free_name

def in_order(rows: DataFrame, order: list[str], seq: str = "seq") -> DataFrame:
    """``rows`` dealt by ranges of ``order`` (nulls first) with a number that grows in that order.

    The number's upper bits are the partition, so rows of one key that fills many partitions need not meet in any task. Equal rows are dealt by the
    place where they were read, so that a row repeated very often is spread, too. The order of rows that agree on all of ``order`` is free.
    """
    tie = free_name(rows.columns, "_read_at")
    placed = rows.withColumn(tie, F.monotonically_increasing_id())
    keys = [*order, tie]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie).withColumn(seq, F.monotonically_increasing_id())


def digests(pieces: DataFrame, keys: list[str], place: str, text: str = "text", between: bytes = b"", skip: int = 0) -> DataFrame:
    """(keys, sha256): the digest over each key's pieces in the order of ``place``, with ``between`` between them and
    without the first ``skip`` bytes of each key's first piece.

    A digest is one chain of blocks, so all bytes of a key must pass one task in turn; they stream through it with constant memory.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in pieces.select(*keys).dtypes)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kinds = None, None, []

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), [*kinds, pa.string()], strict=True)], [*keys, "sha256"])

        for b in batches:
            kinds, done = [b.column(k).type for k in keys], []
            for name, piece in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column(text), strict=True):
                if name != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state, drop = name, hashlib.sha256(), skip
                else:
                    state.update(between)
                    drop = 0
                piece = piece.as_py()
                state.update((piece if isinstance(piece, bytes) else piece.encode())[drop:])
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(*key, state.hexdigest())])

    dealt = pieces.select(*keys, place, text).repartition(*keys).sortWithinPartitions(*keys, place).select(*keys, text)
    return dealt.mapInArrow(chain, f"{schema}, sha256 string")
