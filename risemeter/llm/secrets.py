"""Secret scan: strong patterns, and weak parts of multipart credentials linked by an interval join.

Strong (base) spans, leftmost and non-overlapping per kind: ``assign`` (a secret's name, ``:`` or ``=``, a value of 6 characters or more),
``access`` (``AKIA`` identifiers of 20 characters or more) and ``hex`` (runs of 24 hexadecimal digits or more). They are always reported.

Weak parts say little on their own: an upper-case identifier with digits (``weak_id``), a long token of mixed characters (``weak_secret``), an
endpoint. Each weak part opens a scope of ``SCOPE`` characters around it, and the scopes are joined with the intervals of the complementary parts:
an identifier counts if a secret lies in its scope, a secret if an identifier or an endpoint does. Parts are held sorted by
place, so the join takes one binary search per part and never lists all pairs. A scope does not leave its text, so the join needs no shuffle.

Defined results: a null text counts as empty and has no spans; a weak part that overlaps a base span is not reported; null ids are kept; repeated
rows are reported each; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SCOPE = 300
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret")
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Z0-9]{16,}+(?![A-Za-z0-9+/_=-])")
DIGIT = re.compile(r"[0-9]")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|[a-z0-9-]+(?:\.[a-z0-9-]+){1,8}:[0-9]{2,5})")

#: Linear-time test that every text with a base span or a weak part passes.
CANDIDATE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{20}"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _mixed(token: str) -> bool:
    kinds = (any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token))
    return all(kinds) and len(set(token)) >= 10


class Parts:
    """Intervals of one role, as sorted runs in which starts and ends both grow."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        """Whether an interval begins before ``end`` and ends after ``start``."""
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak parts whose scope holds a complementary part."""
    taken = Parts([(a, b) for _, a, b in base])
    ids = [m.span() for m in WEAK_ID.finditer(text) if DIGIT.search(m.group()) and not taken.meets(*m.span())]
    known = Parts(ids)
    secrets = [m.span() for m in WEAK_SECRET.finditer(text) if _mixed(m.group()) and not taken.meets(*m.span()) and not known.meets(*m.span())]
    if not ids and not secrets:
        return []
    identifiers = Parts(ids + [(a, b) for k, a, b in base if k == "access"])
    endpoints = Parts([m.span() for m in ENDPOINT.finditer(text)]) if secrets else Parts([])
    strong = Parts(secrets + [(a, b) for k, a, b in base if k in ("assign", "hex")])
    found = [("weak_id", a, b) for a, b in ids if strong.meets(a - scope, b + scope)]
    return found + [("weak_secret", a, b) for a, b in secrets if identifiers.meets(a - scope, b + scope) or endpoints.meets(a - scope, b + scope)]


def scan(texts: pa.Array, scope: int = SCOPE) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    texts = pc.fill_null(texts, "")
    for row, hit in enumerate(pc.match_substring_regex(texts, CANDIDATE).to_pylist()):
        if not hit:
            yield [], []
            continue
        text = texts[row].as_py()
        base = base_spans(text)
        yield base, ordered(base + linked_spans(text, base, scope))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found) of every row.

    The counts and the digest are those of the base spans; ``spans`` is all of them as text and ``found`` as an array of structs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            both = list(scan(b.column("text"), scope))
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS[:3]]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both], pa.string())
            spans = pa.array([written(every) for _, every in both], pa.string())
            found = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in every] for _, every in both], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digests, spans, found], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    runs = Parts([(a, b) for _, a, b in spans])
    for a, b in zip(runs.starts, runs.ends, strict=True):
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span masked in ``text``; ``n_chars``, where it is a column, becomes the new length of changed texts."""
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            changed = [(row, spans) for row, (_, spans) in enumerate(scan(b.column(at), scope)) if spans]
            if not changed:
                yield b
                continue
            held = list(b.columns)
            sizes = None if length is None else b.column(length).to_pylist()
            for row, spans in changed:
                texts[row] = masked(texts[row], spans)
                if sizes is not None:
                    sizes[row] = len(texts[row])
            held[at] = pa.array(texts, b.schema.types[at])
            if length is not None:
                held[length] = pa.array(sizes, b.schema.types[length])
            yield pa.RecordBatch.from_arrays(held, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
