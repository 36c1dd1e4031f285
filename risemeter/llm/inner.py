"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Vectors become integers (``floor(SCALE * x)`` per component), and the score is their exact integer inner product.

1. The Gram matrix of all vectors is summed per task; its eigenvectors (the right singular vectors of the data) rotate queries and candidates, so
   that the first coordinates hold as much of each inner product as possible.
2. Candidates are dealt into shards by descending length; a range partitioning that also takes the id, so that equal vectors are spread. Queries
   come in blocks. A task multiplies one block with one shard, so its memory is bounded by the two sizes, whatever the input.
3. The longest vectors of all (a bounded number) give each query a first threshold: its k-th best score among them.
4. In a task, candidates go by descending length. By Cauchy-Schwarz no candidate can score more than its length times the query's; once that is under
   the thresholds of all queries of the block, the rest of the shard is skipped. Of the others, the first ``LEADING`` coordinates
   are multiplied; the residual lengths bound the rest, and pairs that cannot reach the query's threshold are dropped. The pairs left are scored in integers.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Components of which ``SCALE`` times
exceeds a long, and scores that exceed one, raise an error; products too large for 64-bit sums are made in whole numbers of any size. Vectors of different lengths are multiplied as far as the shorter goes. A candidate with the query's id is the query
itself. Repeated candidates count each; of several query rows with one id the smallest vector asks. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from risemeter.llm.tables import saved

SCALE = 256
K = 5
QUERY_BLOCK = 2048
SHARD = 16384
STEP = 1024
LEADING = 24
LONGEST = 1024
#: Stands for no score; its negative is a number, too.
LOWEST = np.iinfo(np.int64).min + 1
#: Stand for scores beyond a long; among the best of a query they are an error.
LEAST, MOST = LOWEST + 1, np.iinfo(np.int64).max


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>, norm): the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    valid = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    parsed = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(valid)
    fits = lambda c: (c >= -(2.0**63)) & (c < 2.0**63)
    v = F.transform(x, lambda c: F.when(fits(F.floor(c * scale).cast("double")), F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a component exceeds a long")).cast("long")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    return parsed.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", norm)


def _matrix(column: pd.Series | list, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def rotation(parsed: DataFrame, width: int) -> np.ndarray:
    """Columns: right singular vectors of all vectors, by descending singular value."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    cells = parsed.select("v").mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    matrix = np.zeros(width * width)
    matrix[cells.cell.to_numpy()] = cells.value.to_numpy()
    _, vectors = np.linalg.eigh(matrix.reshape(width, width))
    return vectors[:, ::-1]


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th largest, or the smallest integer if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), LOWEST)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where these hold every sum, else in longs, else in whole numbers of any size."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def block_top(
    ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, names: np.ndarray, shard: np.ndarray, turn: np.ndarray, k: int, leading: int = LEADING
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores): of each query at least those of its k best in ``shard`` that reach its floor."""
    lengths = np.linalg.norm(shard.astype(float), axis=1)
    order = np.argsort(-lengths, kind="stable")
    names, shard, lengths = names[order], shard[order], lengths[order]
    q = queries.astype(float) @ turn
    q_length, q_rest = np.linalg.norm(q, axis=1), np.linalg.norm(q[:, leading:], axis=1)
    floors = floors.copy()
    best_names, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)
    for first in range(0, len(shard), STEP):
        part, own = shard[first : first + STEP], names[first : first + STEP]
        slack = 1e-6 * (1 + q_length * lengths[first])  # more than the rounding of the rotated sums
        open_ = np.flatnonzero(q_length * lengths[first] + slack >= floors)
        if not len(open_):
            break
        c = part.astype(float) @ turn
        bound = q[open_, :leading] @ c[:, :leading].T + np.outer(q_rest[open_], np.linalg.norm(c[:, leading:], axis=1))
        reach = (bound + slack[open_, None] >= floors[open_, None]) & (own[None, :] != ids[open_, None])
        live = np.flatnonzero(reach.any(axis=0))
        if not len(live):
            continue
        scores = np.where(reach[:, live], _products(queries[open_], part[live]), LOWEST)
        all_scores = np.concatenate([best[open_], scores], axis=1)
        all_names = np.concatenate([best_names[open_], np.broadcast_to(own[live], scores.shape)], axis=1)
        top = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
        kept_scores, kept_names = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_names, top, 1)
        grown_scores, grown_names = np.full((len(ids), k), LOWEST), np.zeros((len(ids), k), np.int64)
        grown_scores[:, : best.shape[1]], grown_names[:, : best.shape[1]] = best, best_names
        grown_scores[open_, : kept_scores.shape[1]], grown_names[open_, : kept_names.shape[1]] = kept_scores, kept_names
        best, best_names = grown_scores, grown_names
        floors = np.maximum(floors, best[:, k - 1])
    row, place = np.nonzero(best > LOWEST)
    if np.isin(best[row, place], (LEAST, MOST)).any():
        raise OverflowError("a score exceeds a long")
    return ids[row], best_names[row, place], best[row, place]


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query row."""
    parsed = saved(integers(vectors), "vectors")
    asked = parsed.where(F.coalesce(is_query, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))
    facts = parsed.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id long, vec_id long, score long"
    width = facts.width or 0
    turn = rotation(parsed, width) if width else np.zeros((0, 0))
    longest = parsed.orderBy(F.desc("norm"), "vec_id").limit(LONGEST).select("vec_id", "v").collect()
    seed_names, seeds = np.array([r.vec_id for r in longest], dtype=np.int64), _matrix([r.v for r in longest], width)

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column("vec_id"))
            scores = _products(_matrix(b.column("v").to_pylist(), width), seeds)
            scores = np.where(ids[:, None] == seed_names[None, :], LOWEST, scores)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(_kth_best(scores, k))], ["vec_id", "v", "floor"])

    queries = saved(asked.select("vec_id", "v").mapInArrow(with_floor, "vec_id long, v array<long>, floor long"), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    shards = max(1, -(-facts.n // shard_rows))
    dealt = parsed.repartitionByRange(shards, F.desc("norm"), "vec_id").withColumn("shard", F.spark_partition_id())
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # Every block meets every shard: queries are the stated set, and each pair of a block and a shard is one bounded task.
    left = numbered.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))) if shards > 1 else numbered.withColumn("shard", F.lit(0))
    right = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else dealt.withColumn("block", F.lit(0))

    def multiply(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = block_top(
            asking.vec_id.to_numpy(), _matrix(asking.v.tolist(), width), asking.floor.to_numpy(), held.vec_id.to_numpy(), _matrix(held.v.tolist(), width), turn, k
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    best = left.groupBy("block", "shard").cogroup(right.select("block", "shard", "vec_id", "v").groupBy("block", "shard")).applyInPandas(multiply, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
