"""Title matching against a catalog of names and aliases.

Containment of any of many terms in any of many texts is a theta join. It is made an equi join
without losing pairs: every term is filed under one of its own n-grams (its anchor), every text
offers all its n-grams, and a text can only contain a term whose anchor it offers. Candidate
pairs are then verified on the full text.

* Anchors are as long as the term allows (1 to 16 characters) and the rarest of the term's
  n-grams within the catalog, so common prefixes never become hot join keys. A term of at most
  16 characters is its own anchor, so that nearly all its candidates contain it.
* Texts only offer lengths that occur among the anchors.
* A bit table of all anchors, of bounded size, travels as one column value. N-grams that are no
  anchor fall at it where they are made, before anything moves, whatever the size of the catalog.
* N-grams are made as 64-bit hashes by one rolling pass (``functions/grams.py``) and travel with a place each, without the text. Texts move
  by item before they are normalized and hashed, as one file may hold them in a single row group, are written, move once
  more, by item, and are read for the check of all their candidates at a time.
* Exclusions and resolving keywords are terms like others, so that no text is looked up again.
* Which term lies inside which longer one is a fact of the catalog, written with the index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from risemeter.functions.grams import whole_hash, with_gram_hashes
from risemeter.functions.text import (
    is_safe_term,
    is_safe_token,
    normalize_array,
    normalize_text,
    nfkc_array,
    split_tokens,
    strip_text,
    utf16_length,
)
from risemeter.session import spread, written

GRAM_LENGTHS = list(range(1, 17))

# The bit table has about so many bits per anchor, and at most so many bits (2 MB).
BITS_PER_ANCHOR, MOST_BITS = 1024, 1 << 24

ROLES = ("name", "alias", "ambiguous", "weak")
MATCHING_ROLES = ("name", "alias", "ambiguous")
# More positions than any entry lists terms.
POSITIONS = 1_000_000_000

# Confidence of the three kinds of match.
NAME_CONFIDENCE, ALIAS_CONFIDENCE, RESOLVED_CONFIDENCE = 100, 85, 75

_NO_STRINGS = "array<string>"


def _own_grams(text: Column, length: Column) -> Column:
    """All n-grams of the given length, which is at most that of the text."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda start: F.substr(text, start, length))


def _length_class(length: Column) -> Column:
    """The largest anchor length that fits."""
    return F.when(length >= 1, F.least(length, F.lit(GRAM_LENGTHS[-1])))


def anchored(texts: DataFrame) -> DataFrame:
    """Add ``anchor``: the hash of the rarest n-gram of each ``term_text``, at its ``anchor_length``, and ``anchor_at``, the byte of the
    term at which it begins. Texts are distinct."""
    sized = texts.withColumn("anchor_length", _length_class(F.length("term_text")))
    own = _own_grams(F.col("term_text"), F.col("anchor_length"))
    grams = sized.select("term_id", "anchor_length", F.explode(F.array_distinct(own)).alias("_gram"))
    usage = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_uses"))
    anchors = grams.join(usage, "_gram").groupBy("term_id", "anchor_length").agg(
        F.min_by("_gram", F.struct("_uses", "_gram")).alias("_gram")
    )
    named = texts.join(anchors.withColumn("anchor", whole_hash(F.col("_gram"))), "term_id")
    return named.withColumn("anchor_at", F.octet_length(F.call_function("substring_index", F.col("term_text"), F.col("_gram"), F.lit(1)))).drop("_gram")


def anchor_bits(terms: DataFrame, anchors: int) -> tuple[DataFrame, int]:
    """One row with the bit table of all anchors as an array of longs, and its number of bits (a power of two).

    The table is bounded; with more anchors than it has room for, more n-grams pass, and none is lost.
    """
    bits = 1 << max(10, min(MOST_BITS, anchors * BITS_PER_ANCHOR).bit_length())
    place = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    held = terms.select(F.shiftright(place, 6).alias("id"), F.expr("shiftleft(1L, cast(anchor & 63 as int))").alias("bit"))
    held = held.groupBy("id").agg(F.bit_or("bit").alias("bit"))
    words = terms.sparkSession.range(bits // 64).join(held, "id", "left").select(F.struct("id", F.coalesce("bit", F.lit(0)).alias("bit")).alias("w"))
    return words.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w.bit).alias("words")), bits


@dataclass
class CatalogIndex:
    """The term side of the join, written once and read by every use.

    ``terms`` has term_id, term_text, is_guard, anchor, anchor_at, one row per distinct text. ``entries`` has
    term_id, catalog_id, role, rank, term, confirms, guarded, one row per entry and term. ``guards`` has
    catalog_id and the term ids of its exclusions and resolvers, for entries that have any.
    ``covers`` has (longer_id, term_id) for each term inside a longer one.
    ``words`` is the bit table of the anchors with ``bits`` bits, ``held`` the same table, at most 2 MB, for the tasks
    that make n-grams, ``lengths`` are the anchor lengths that occur.
    """

    terms: DataFrame
    entries: DataFrame
    guards: DataFrame
    words: DataFrame
    bits: int
    held: np.ndarray
    lengths: list[int]
    covers: DataFrame | None = None

    def offers(self, gram: Column) -> Column:
        """Whether the hash of an n-gram is in the bit table."""
        word = F.get(self.words.scalar(), F.shiftright(gram.bitwiseAND(F.lit(self.bits - 1)), 6).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), gram.bitwiseAND(F.lit(63)).cast("int"))
        return word.bitwiseAND(bit) != 0


def index_catalog(catalog: DataFrame, roles: tuple[str, ...] | None = None) -> CatalogIndex:
    """Prepare the catalog for matching, once, in tables of the shared folder. Joins with them follow from their sizes."""
    guards = catalog_guards(catalog)
    listed = catalog_term_rows(catalog, roles or ROLES).join(guards, "catalog_id")
    # An exclusion that normalizes to nothing is in every title, and so is such a resolver.
    rows = listed.where(~F.array_contains("exclusions", "")).select(
        "catalog_id", "role", "rank", "term", "term_text", "confirms",
        (F.size("exclusions") > 0).alias("guarded"), F.array_contains("resolvers", "").alias("resolves"),
    )
    rows = written(rows, "term-rows")
    checks = written(
        guards.select("catalog_id", F.explode("exclusions").alias("term_text"), F.lit(True).alias("excludes"))
        .unionByName(guards.select("catalog_id", F.explode("resolvers").alias("term_text"), F.lit(False).alias("excludes")))
        .where("term_text <> ''"),
        "guard-rows",
    )
    used = rows.select("term_text", F.lit(False).alias("is_guard")).unionByName(checks.select("term_text", F.lit(True).alias("is_guard")))
    texts = written(used.groupBy("term_text").agg(F.max("is_guard").alias("is_guard")).withColumn("term_id", F.monotonically_increasing_id()), "term-texts")
    terms = written(anchored(texts), "terms")
    entries = written(rows.join(texts.select("term_text", "term_id"), "term_text").drop("term_text"), "entries")
    ids = lambda wanted: F.collect_set(F.when(wanted, F.col("term_id")))
    listed_guards = checks.join(texts.select("term_text", "term_id"), "term_text").groupBy("catalog_id").agg(
        ids(F.col("excludes")).alias("exclusions"), ids(~F.col("excludes")).alias("resolvers")
    )
    # The longest anchor is no longer than its term, so the lengths and their number are facts of the terms.
    facts = terms.select(_length_class(F.length("term_text")).alias("n")).groupBy("n").count().collect()
    words, bits = anchor_bits(terms, sum(r["count"] for r in facts))
    words = written(words, "anchor-bits")
    held = np.array(words.first()["words"], dtype=np.int64).view(np.uint64)
    return CatalogIndex(terms, entries, written(listed_guards, "guards"), words, bits, held, sorted(r["n"] for r in facts))


def offering(texts: DataFrame, text_id: str, text: str, index: CatalogIndex) -> DataFrame:
    """(text_id, text, offered, places): each text with the hashes and places of its n-grams that may be anchors.

    Written, as it is read for the n-grams and for the check: a plan that holds the hashing twice does it twice.
    """
    return written(with_gram_hashes(texts, text, index.lengths, index.held), "offered")


def containing_pairs(texts: DataFrame, text_id: str, text: str, index: CatalogIndex, guards: bool = False) -> DataFrame:
    """(text_id, term_id, is_guard) for every indexed term contained in the text, or only those that are guards.

    ``texts`` come from ``offering``. The terms that may lie in a text are gathered as one list, which meets
    the text once. Hashes and texts move by ``text_id``, once each, into all shuffle partitions: the work follows
    from the candidates and the lengths of the texts, not from the bytes by which Spark would merge partitions.
    A candidate is compared with the bytes at the place of its anchor, and the text is searched only if they differ.
    """
    hashes = spread(texts.select(text_id, "offered", "places"), text_id)
    zipped = hashes.select(text_id, F.explode(F.arrays_zip("offered", "places")).alias("_gram"))
    known = zipped.select(text_id, F.col("_gram.offered").alias("anchor"), F.col("_gram.places").alias("_place"))
    terms = index.terms.where("is_guard") if guards else index.terms
    terms = terms.select("anchor", "anchor_at", "term_id", "term_text", "is_guard")
    candidates = known.where(index.offers(F.col("anchor"))).join(terms, "anchor").withColumn("_at", F.col("_place") - F.col("anchor_at") + 1)
    # Terms become bytes behind the join: Spark takes bytes for five times as wide as text, and would rather broadcast the n-grams.
    candidate = F.struct("term_id", "is_guard", F.col("term_text").cast("binary").alias("_term"), "_at")
    listed = candidates.groupBy(text_id).agg(F.collect_list(candidate).alias("_terms"))
    whole = spread(texts.select(text_id, F.col(text).cast("binary").alias("_whole")), text_id)
    checked = listed.join(whole.hint("merge"), text_id).select(text_id, "_whole", F.inline("_terms"))
    # Equal bytes anywhere are the term, so a place of another occurrence, text of a repeated id or n-gram of the same hash loses and adds nothing.
    there = F.substr("_whole", F.col("_at"), F.octet_length("_term")) == F.col("_term")
    return checked.where(there | F.contains("_whole", "_term")).select(text_id, "term_id", "is_guard")


def covering_terms(index: CatalogIndex) -> DataFrame:
    """(longer_id, term_id): each indexed term that lies inside a longer one. A longer term holds no more than its own parts."""
    texts = index.terms.select(F.col("term_id").alias("longer_id"), F.col("term_text").alias("longer"))
    inside = containing_pairs(offering(texts, "longer_id", "longer", index), "longer_id", "longer", index).select("longer_id", "term_id")
    sizes = index.terms.select("term_id", utf16_length(F.col("term_text")).alias("units"))
    longer = sizes.select(F.col("term_id").alias("longer_id"), F.col("units").alias("longer_units"))
    return inside.join(sizes, "term_id").join(longer, "longer_id").where("longer_units > units").select("longer_id", "term_id")


def _strings(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(_NO_STRINGS))


def _in_role(role: str) -> Column:
    return F.transform(role, lambda t, i: F.struct(F.lit(role).alias("role"), i.alias("position"), t.alias("term")))


def catalog_term_rows(catalog: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """One row per usable term of the catalog with its role, for the asked roles.

    Roles: ``name`` (matches at any length), ``alias`` and ``ambiguous`` (safe terms in order),
    ``weak`` (tokens that only suggest a match). ``confirms`` marks the terms whose presence
    settles a title, so that it needs no review. ``rank`` orders the terms of one entry and role
    as one whole number: aliases by length, longest first, then position; others by position.
    """
    everything = F.concat(
        F.array("name", "short_name"), _strings("aliases"), _strings("unique_aliases"), _strings("ambiguous_aliases")
    )
    filled = F.filter(everything, lambda t: t.isNotNull() & (t != ""))
    sources = catalog.select(
        "catalog_id",
        F.array("name").alias("name"),
        F.concat(F.array("short_name"), _strings("aliases"), _strings("unique_aliases")).alias("alias"),
        _strings("ambiguous_aliases").alias("ambiguous"),
        split_tokens(nfkc_array(filled)).alias("weak"),
    )
    terms = F.flatten(F.array(*[_in_role(role) for role in roles]))
    listed = sources.select("catalog_id", F.inline(terms)).where(F.col("term").isNotNull() & (F.col("term") != ""))
    normalized = listed.withColumn("term_text", normalize_text(F.col("term"))).where(F.col("term_text") != "")
    safe = is_safe_term(F.col("term_text"))
    usable = (
        F.when(F.col("role") == "name", F.lit(True))
        .when(F.col("role") == "weak", is_safe_token(F.col("term_text")))
        .otherwise(safe)
    )
    confirms = F.col("role").isin("name", "alias") & safe
    by_length = F.when(F.col("role") == "alias", utf16_length(F.col("term")).cast("long") * F.lit(-POSITIONS)).otherwise(
        F.lit(0).cast("long")
    )
    return (
        normalized.where(usable)
        .withColumn("confirms", confirms)
        .withColumn("rank", by_length + F.col("position"))
        .drop("position")
    )


def catalog_guards(catalog: DataFrame) -> DataFrame:
    """Normalized exclusion terms and resolving keywords per entry, checked only where a term hits."""
    return catalog.select(
        "catalog_id",
        normalize_array(F.col("exclude_terms")).alias("exclusions"),
        normalize_array(F.col("resolving_keywords")).alias("resolvers"),
    )


def title_hits(items: DataFrame, index: CatalogIndex) -> DataFrame:
    """Per (item, entry) whose terms occur in the title and whose exclusions do not.

    ``items`` has (item_id, title), optionally ``title_text`` with the title normalized earlier.
    Columns: the matched method, confidence, term and its id (NULL without a match), and
    ``is_ambiguous`` for pairs that only deserve a review (needs the weak role).
    """
    known = "title_text" in items.columns
    normalized = F.col("title_text") if known else normalize_text(F.col("title"))
    # A scan has no more tasks than its files have row groups, however much text these hold.
    dealt = spread(items.select("item_id", "title_text" if known else "title"), "item_id")
    texts = dealt.select("item_id", F.coalesce(normalized, F.lit("")).alias("title_text"))
    texts = offering(texts, "item_id", "title_text", index)
    found = containing_pairs(texts, "item_id", "title_text", index)
    # From here rows are a few numbers wide, so that the grouping is a hash aggregation with
    # map-side combine. It keeps the items' partitioning.
    columns = ["term_id", "catalog_id", "role", "rank", "confirms", "guarded", "resolves"]
    best = [F.min(F.when(F.col("role") == role, F.col("rank"))).alias(f"_{role}") for role in ROLES]
    flags = [F.max(flag).alias(f"_{flag}") for flag in ("confirms", "guarded", "resolves")]
    pairs = found.join(index.entries.select(*columns), "term_id").groupBy("item_id", "catalog_id").agg(*best, *flags)

    by_name, by_alias, by_ambiguous = (F.col(f"_{r}").isNotNull() for r in MATCHING_ROLES)
    # The guards of a title are parts of it; they meet those of an entry only where these decide.
    guards = containing_pairs(texts, "item_id", "title_text", index, guards=True)
    present = guards.groupBy(F.col("item_id").alias("_item")).agg(F.collect_set("term_id").alias("_present"))
    asks = F.col("_guarded") | (by_ambiguous & ~by_name & ~by_alias)
    guarded = pairs.join(present, (F.col("item_id") == F.col("_item")) & asks, "left").join(index.guards, "catalog_id", "left")
    hit = lambda guards: F.coalesce(F.arrays_overlap(guards, "_present"), F.lit(False))
    resolved = F.col("_resolves") | hit("resolvers")
    chosen = (
        F.when(by_name, _choice("name", "exact_name", NAME_CONFIDENCE))
        .when(by_alias, _choice("alias", "alias", ALIAS_CONFIDENCE))
        .when(by_ambiguous & resolved, _choice("ambiguous", "alias", RESOLVED_CONFIDENCE))
    )
    ambiguous = F.col("_weak").isNotNull() & ~F.col("_confirms")
    flagged = guarded.where(~hit("exclusions")).select(
        "item_id", "catalog_id", chosen.alias("_c"), ambiguous.alias("is_ambiguous")
    ).select("item_id", "catalog_id", "_c.*", "is_ambiguous")
    keys = ["catalog_id", "role", "rank"]
    return flagged.join(index.entries.select(*keys, "term", "term_id"), keys, "left").drop("role", "rank")


def _choice(role: str, method: str, confidence: int) -> Column:
    return F.struct(
        F.lit(role).alias("role"),
        F.col(f"_{role}").alias("rank"),
        F.lit(method).alias("method"),
        F.lit(confidence).alias("confidence"),
    )


def judged_pairs(hits: DataFrame, index: CatalogIndex) -> DataFrame:
    """Title hits with ``is_match``: a match counts unless its term lies inside a longer matched
    term of another entry in the same title.

    An entry has one term per title, so a longer term always belongs to another entry, and it is
    enough to know the distinct terms of the title: each of them covers the terms inside it, which
    the index lists.
    """
    covers = index.covers if index.covers is not None else covering_terms(index)
    # Read twice below, and made only once.
    hits = written(hits, "title-hits")
    matched = hits.where("method is not null").select("item_id", F.col("term_id").alias("longer_id")).distinct()
    covered = matched.join(covers, "longer_id").select("item_id", "term_id", F.lit(True).alias("_covered")).distinct()
    is_match = F.col("method").isNotNull() & F.col("_covered").isNull()
    return hits.join(covered, ["item_id", "term_id"], "left").withColumn("is_match", is_match).drop("_covered", "term_id")


def match_titles(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Confirmed matches (item_id, catalog_id, method, confidence, term)."""
    index = index_catalog(catalog, MATCHING_ROLES)
    hits = title_hits(items, index).where(F.col("method").isNotNull())
    return judged_pairs(hits, index).where("is_match").drop("is_match", "is_ambiguous")


def ambiguous_candidates(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """(item_id, catalog_id) pairs that only weak tokens suggest."""
    return title_hits(items, index_catalog(catalog)).where("is_ambiguous").select("item_id", "catalog_id")


def matching_entries(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows that match any title."""
    return catalog.join(match_titles(items, catalog).select("catalog_id"), "catalog_id", "left_semi")
