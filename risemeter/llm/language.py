"""Language identification: script ranges, per-word scores, and a Viterbi path with a switching penalty.

**Model.** Hashed character trigrams of all training documents are counted per language, and so are the letters of each script. Both tables have a fixed
size (buckets or scripts times languages), so they are summed in Spark and travel with the tasks. A trigram's score is its smoothed log-probability.

**Scores.** A word takes part in the languages that its script allows: those in which the script holds at least ``SCRIPT_SHARE`` of all
training letters, or all languages if none does. Its score per language is the sum over its trigrams, relative to the best language and not
below ``WORST``; a word without letters scores 0 everywhere.

**Path.** The best sequence of languages over the words of a document maximises the sum of the word scores minus ``SWITCH`` per change of language. Most
documents are of one language, and for these a certificate suffices: if no stretch of words gains more than a change costs by another language, and none
at an end of the text more than half of it, the constant path is optimal. The stretch that gains most follows from running sums, without a loop over
words. All other documents take the full Viterbi recursion. Spans of one language follow, and the document's language is the one that holds most letters.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no spans; so is everything if there are no training rows. Ties go to the
language that sorts first. Null ids are kept and count as not held out; repeated rows are reported each; further columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from risemeter.llm.quality import remainder
from risemeter.llm.words import mix, slices

BUCKETS = 1 << 16
SWITCH = 12.0
WORST = -8.0
SCRIPT_SHARE = 0.001
UNKNOWN = "und"

#: First code points of script ranges, in order; a range ends where the next begins. Fixed values of the Unicode blocks.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in RANGES))
_FIRST = np.array([first for first, _ in RANGES], dtype=np.uint32)
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in RANGES], dtype=np.uint8)


def _letters(limit: int = 0x3400) -> np.ndarray:
    """Whether a code point below ``limit`` is a letter; marks are none, also those that belong to one."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(limit)])


LETTERS = _letters()


def is_letter(codes: np.ndarray) -> np.ndarray:
    near = LETTERS[np.minimum(codes, len(LETTERS) - 1)]
    far = codes >= len(LETTERS)
    if far.any():
        own = np.unique(codes[far])
        known = np.array([unicodedata.category(chr(c))[0] == "L" for c in own])
        near = near.copy()
        near[far] = known[np.searchsorted(own, codes[far])]
    return near


@dataclass
class Characters:
    """The characters of some texts: lower case, a blank behind each text."""

    codes: np.ndarray
    letter: np.ndarray
    #: For each word (run of non-blanks) first and last + 1 character; for each text first and last + 1 word.
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Characters:
        held = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
        codes = np.frombuffer((" " + " ".join(held) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) for t in held], dtype=np.int64)
        begins = 1 + np.concatenate(([0], np.cumsum(sizes + 1)))
        blank = (codes <= 32) | (codes == 0xA0) | (codes == 0x3000)
        edges = np.diff(blank.astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
        return cls(codes, is_letter(codes), starts, ends, np.searchsorted(starts, begins))

    def trigrams(self) -> np.ndarray:
        """The bucket of the three characters around each letter; -1 at other characters. What is no letter counts as blank."""
        seen = np.where(self.letter, self.codes, 32).astype(np.uint64)
        around = np.concatenate(([32], seen[:-1])).astype(np.uint64), np.concatenate((seen[1:], [32])).astype(np.uint64)
        bucket = (mix((around[0] << np.uint64(42)) | (seen << np.uint64(21)) | around[1]) >> np.uint64(48)).astype(np.int64) % BUCKETS
        return np.where(self.letter, bucket, -1)

    def scripts(self) -> np.ndarray:
        return _SCRIPT[np.searchsorted(_FIRST, self.codes, "right") - 1]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: (buckets, languages) log-probabilities, and (scripts, languages) whether a language is written so.
    scores: np.ndarray
    allowed: np.ndarray


def train(docs: DataFrame) -> Model:
    """Count all rows with a text and a language whose crc32 of the id, modulo 5, is not 0."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(True))).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            names = np.array(b.column("lang").to_pylist(), dtype=object)
            for name in dict.fromkeys(names):
                own = b.column("text").filter(pa.array(names == name))
                table = totals.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                for first, last in slices(own):
                    found = Characters.of(own.slice(first, last - first))
                    grams = found.trigrams()
                    table[:BUCKETS] += np.bincount(grams[grams >= 0], minlength=BUCKETS)
                    table[BUCKETS:] += np.bincount(found.scripts()[found.letter], minlength=len(SCRIPTS))
        for name, table in totals.items():
            cells = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(table[cells])], ["lang", "cell", "n"])

    sums = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(sums.column("lang").to_pylist(), dtype=object)
    languages = tuple(sorted(set(names)))
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    place = {name: k for k, name in enumerate(languages)}
    table[sums.column("cell").to_numpy(), [place[n] for n in names]] = sums.column("n").to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    scores = np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 0.5 * BUCKETS) if languages else grams
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, scores.astype(np.float32), allowed)


def word_scores(model: Model, found: Characters) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words, languages), and letters per word."""
    grams = found.trigrams()
    table = np.concatenate([model.scores, np.zeros((1, len(model.languages)), np.float32)])
    runs = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(table[grams], axis=0, dtype=np.float64)])
    letters = np.concatenate(([0], np.cumsum(found.letter)))
    scores, letters = runs[found.ends] - runs[found.starts], letters[found.ends] - letters[found.starts]
    first = np.zeros(len(found.starts), dtype=np.int64)  # a word's script is that of its first letter
    at = np.flatnonzero(found.letter)
    if len(at):
        first = at[np.minimum(np.searchsorted(at, found.starts), len(at) - 1)]
    barred = ~model.allowed[found.scripts()[first]]
    scores[barred] = -np.inf
    scores -= scores.max(axis=1, keepdims=True, initial=-np.inf) if len(scores) else 0
    return np.where(letters[:, None] > 0, np.maximum(scores, WORST), 0.0), letters


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path."""
    n, k = scores.shape
    totals = scores.sum(axis=0)
    main = int(totals.argmax())
    gain = np.concatenate([np.zeros((1, k)), np.cumsum(scores - scores[:, [main]], axis=0)])
    within = (gain - np.minimum.accumulate(gain, axis=0)).max()
    ends = max(gain.max(), (gain[-1] - gain.min(axis=0)).max())
    if within <= switch and ends <= switch / 2:
        return np.full(n, main)
    value, back = scores[0].copy(), np.zeros((n, k), dtype=np.int64)
    stay = np.arange(k)
    for t in range(1, n):
        other = int(value.argmax())
        change = value[other] - switch > value
        back[t] = np.where(change, other, stay)
        value = np.where(change, value[other] - switch, value) + scores[t]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(value.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(model: Model, texts: pa.Array) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language) in code points of each text."""
    for first, last in slices(texts, 1_000_000):
        part = texts.slice(first, last - first)
        found = Characters.of(part)
        scores, letters = word_scores(model, found) if model.languages else (np.zeros((len(found.starts), 0)), np.zeros(len(found.starts), int))
        sizes = np.asarray(pc.fill_null(pc.utf8_length(pc.utf8_lower(part)), 0), dtype=np.int64)
        begins = 1 + np.concatenate(([0], np.cumsum(sizes + 1)))
        for row in range(last - first):
            a, b = found.bounds[row], found.bounds[row + 1]
            own = letters[a:b]
            if not own.sum() or not model.languages:
                yield UNKNOWN, 0.0, []
                continue
            path = best_path(scores[a:b])
            held = np.bincount(path, own, minlength=len(model.languages))
            best = int(held.argmax())
            # How sure: the share of letters on the path, times the odds against the runner-up within these words.
            totals = scores[a:b][path == best].sum(axis=0)
            odds = 1 / np.exp(np.clip(totals - totals[best], -50, 50)).sum()
            cuts = np.flatnonzero(np.diff(path)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [b - a]))
            spans = [(int(found.starts[a + s] - begins[row]), int(found.ends[a + e - 1] - begins[row]), model.languages[path[s]]) for s, e in zip(starts, ends, strict=True)]
            yield model.languages[best], float(held[best] / own.sum() * odds), spans


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of every row; spans count code points of the text in lower case."""
    model = model or train(docs)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(label(model, b.column("text")))
            spans = pa.array([[{"start": s, "end": e, "lang": x} for s, e, x in own] for *_, own in found], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")
