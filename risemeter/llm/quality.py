"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The machine scores a document as

    logit = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairwise part takes linear time, as half of ``|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2``.

Inputs are ``WORD_BUCKETS`` hashed lower-cased words (weight 1 + ln count, scaled to length 1 per document), and one
active cell for each structure statistic and for the length given as metadata. Labels, languages, sources and ids are no inputs.

Defined results: a null text counts as empty; an empty text is scored from its structure cells; a null ``n_chars``
has a cell of its own. Labels that are null, not 0 or 1, or contradict each other for one document are left out; repeated equal
labels count once. Without labels every score is 0.5; with one class only it is the smoothed share of that class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from risemeter.llm.tables import free_name
from risemeter.llm.words import hash_words, slices, split_words

WORD_BUCKETS = 1 << 15
RANK = 8
#: At most so many labelled documents are used to fit, those with the smallest hashes of their ids.
TRAINING_ROWS = 12_000
CUTOFF = 0.7

CELLS = 16
STATISTICS = 12
WIDTH = WORD_BUCKETS + CELLS * STATISTICS

LOWER, UPPER, DIGIT, BLANK, LINE, MARK, OTHER = range(7)


def _character_classes(limit: int = 0x400) -> np.ndarray:
    classes = np.full(limit + 1, OTHER, dtype=np.uint8)
    for code in range(limit):
        c = chr(code)
        if c == "\n":
            classes[code] = LINE
        elif c.isspace():
            classes[code] = BLANK
        elif c.isdigit():
            classes[code] = DIGIT
        elif c.isupper():
            classes[code] = UPPER
        elif c.isalpha():
            classes[code] = LOWER
        else:
            classes[code] = MARK
    return classes


CLASSES = _character_classes()


def _cell(value: float, most: float = 1.0) -> int:
    """Cell of a share; finer near 0."""
    return min(CELLS - 1, int(math.sqrt(max(0.0, min(1.0, value / most))) * (CELLS - 1) + 0.5))


def _log_cell(value: float) -> int:
    return min(CELLS - 1, int(math.log2(1 + max(0.0, value))))


def _structure(text: str, n_chars: int | None, n_words: int, distinct: int, most_frequent: int) -> list[int]:
    """The active cell of each statistic."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(CLASSES[np.minimum(codes, len(CLASSES) - 1)], minlength=7)
    size, letters = max(1, len(codes)), max(1, counts[LOWER] + counts[UPPER] + counts[OTHER])
    lines = text.split("\n")
    cells = [
        _log_cell(len(codes)),
        _cell(counts[UPPER] / letters),
        _cell(counts[DIGIT] / size, 0.5),
        _cell(counts[MARK] / size, 0.5),
        _cell(counts[BLANK] / size, 0.5),
        _log_cell(4 * len(codes) / max(1, n_words)),
        _cell(distinct / max(1, n_words)),
        _cell(most_frequent / max(1, n_words)),
        _log_cell(4 * len(codes) / len(lines)),
        _cell(1 - len(set(lines)) / len(lines)),
        _cell(counts[MARK] / max(1, n_words), 4.0),
        CELLS - 1 if n_chars is None else min(CELLS - 2, _log_cell(n_chars)),
    ]
    return [WORD_BUCKETS + CELLS * k + cell for k, cell in enumerate(cells)]


def _features(texts: pa.Array, n_chars: list[int | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Active features and their weights, document by document."""
    for first, last in slices(texts):
        part = pc.fill_null(texts.slice(first, last - first), "")
        codes, words, offsets = split_words(pc.utf8_lower(part))
        buckets = (hash_words(words) % np.uint64(WORD_BUCKETS)).astype(np.int64)[codes]
        for k, text in enumerate(part.to_pylist()):
            own = buckets[offsets[k] : offsets[k + 1]]
            ids, counts = np.unique(own, return_counts=True)
            weights = 1 + np.log(counts)
            if len(ids):
                weights /= math.sqrt(float(weights @ weights))
            cells = _structure(text, n_chars[first + k], len(own), len(ids), int(counts.max()) if len(ids) else 0)
            yield np.concatenate((ids, cells)), np.concatenate((weights, np.full(STATISTICS, 0.5)))


@dataclass(frozen=True)
class Machine:
    """A fitted factorisation machine; its size does not depend on the input."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, ids: np.ndarray, weights: np.ndarray) -> float:
        own = self.factors[ids] * weights[:, None]
        total = own.sum(axis=0)
        pairs = 0.5 * (float(total @ total) - float((own * own).sum()))
        return self.bias + float(self.linear[ids] @ weights) + pairs

    def score(self, ids: np.ndarray, weights: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(ids, weights)))))


def constant(share: float) -> Machine:
    return Machine(math.log(share / (1 - share)), np.zeros(WIDTH), np.zeros((WIDTH, RANK)))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, seed: int = 7
) -> Machine:
    """Fit on (features, weights, label) rows by Adagrad on the logistic loss."""
    ones = sum(y for *_, y in rows)
    if not rows:
        return constant(0.5)
    if ones in (0, len(rows)):
        return constant((ones + 1) / (len(rows) + 2))
    dice = np.random.default_rng(seed)
    linear, factors = np.zeros(WIDTH), dice.normal(0, 0.02, (WIDTH, RANK))
    bias = math.log(ones / (len(rows) - ones))
    seen_linear, seen_factors, seen_bias = np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = dice.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[k] for k in order[at : at + batch]]
            sizes = np.array([len(ids) for ids, *_ in part])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            ids = np.concatenate([r[0] for r in part])
            x = np.concatenate([r[1] for r in part])
            y = np.array([r[2] for r in part], dtype=float)
            own = factors[ids] * x[:, None]
            total = np.add.reduceat(own, starts)
            logit = bias + np.add.reduceat(linear[ids] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((own**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(part)
            each = np.repeat(error, sizes) * x
            active, place = np.unique(ids, return_inverse=True)
            g = np.bincount(place, each) + decay * linear[active]
            seen_linear[active] += g * g
            linear[active] -= rate * g / np.sqrt(seen_linear[active])
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - own)
            g = np.stack([np.bincount(place, pull[:, k]) for k in range(RANK)], axis=1) + decay * factors[active]
            seen_factors[active] += g * g
            factors[active] -= rate * g / np.sqrt(seen_factors[active])
            g = float(error.sum())
            seen_bias += g * g
            bias -= rate * g / math.sqrt(seen_bias)
    return Machine(float(bias), linear, factors)


def remainder(doc_id, divisor: int):
    """crc32 of the id as text, modulo ``divisor`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def clean_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """(doc_id, label): one undisputed label of 0 or 1 per document."""
    value = F.col(column)
    return (
        labels.select("doc_id", value.cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .where("label = _most")
        .select("doc_id", "label")
    )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold (crc32 of the id modulo 4 is 2).

    The sample is bounded, so its ids may be broadcast and its features may come to the driver.
    """
    sample = (
        clean_labels(labels)
        .where(remainder(F.col("doc_id"), 4) != 2)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    chosen = docs.select("doc_id", "text", _given_length(docs).alias("n_chars")).join(F.broadcast(sample), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_features(b.column("text"), b.column("n_chars").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("label").cast(pa.int32()),
                    pa.array([ids.astype(np.int32).tobytes() for ids, _ in found], pa.binary()),
                    pa.array([w.astype(np.float32).tobytes() for _, w in found], pa.binary()),
                ],
                ["doc_id", "label", "ids", "weights"],
            )

    found = chosen.mapInArrow(featurise, "doc_id long, label int, ids binary, weights binary").dropDuplicates(["doc_id"])
    table = [(np.frombuffer(r.ids, np.int32).astype(np.int64), np.frombuffer(r.weights, np.float32).astype(float), r.label, r.doc_id) for r in found.collect()]
    table.sort(key=lambda r: r[3])
    return fit([r[:3] for r in table])


def _given_length(docs: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def with_scores(docs: DataFrame, machine: Machine) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and the score; also the name of the score's column, which clashes with none."""
    name = free_name(docs.columns, "score")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [None] * b.num_rows if length is None else b.column(length).to_pylist()
            found = [machine.score(ids, weights) for ids, weights in _features(b.column(at), sizes)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(score, schema), name


def quality_scores(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null id is not held out."""
    machine = train(docs, labels)
    wanted = docs.select("doc_id", "text", _given_length(docs).alias("n_chars"))
    scored, name = with_scores(wanted, machine)
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= cutoff).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows whose score reaches ``cutoff``, with the columns of ``docs``. Without any labels nothing is rejected."""
    machine = train(docs, labels)
    if not machine.linear.any() and machine.bias == 0:
        return docs
    scored, name = with_scores(docs, machine)
    return scored.where(F.col(name) >= cutoff).select(*docs.columns)
