"""Text normalization, safe terms and weak tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The whitespace characters and the punctuation that normalization removes, first as
# parts of a pattern, then as plain characters.
SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
STRIPPED = "・･\\-_()\\[\\]【】「」『』"
SPACE_CHARACTERS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
STRIPPED_CHARACTERS = "・･-_()[]【】「」『』"
# Minimum normalized lengths of terms and tokens, (any script, ASCII letters and digits).
SAFE_TERM_LENGTHS = (4, 6)
SAFE_TOKEN_LENGTHS = (3, 5)

# Joins array elements for one normalization call; NUL never composes with a neighbour.
_SEPARATOR = "\x00"


@F.pandas_udf(StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only texts with non-ASCII characters travel to Python."""
    changed = _nfkc_batch(F.when(text.rlike("[^\\x00-\\x7f]"), text))
    return F.coalesce(changed, text)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def without_characters(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def strip_text(text: Column) -> Column:
    """The part of normalization after NFKC: lower case, whitespace and punctuation removed.

    ``translate`` drops single characters several times faster than a character-class pattern.
    """
    return without_characters(F.lower(text), SPACE_CHARACTERS + STRIPPED_CHARACTERS)


def normalize_text(text: Column) -> Column:
    return strip_text(nfkc(text))


def nfkc_array(texts: Column) -> Column:
    """NFKC of every element of a string array; NULL acts as empty."""
    joined = F.array_join(F.coalesce(texts, F.array().cast("array<string>")), _SEPARATOR)
    parts = F.split(nfkc(joined), _SEPARATOR)
    return F.when(F.size(texts) > 0, parts).otherwise(F.array().cast("array<string>"))


def normalize_array(texts: Column) -> Column:
    return F.transform(nfkc_array(texts), strip_text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit in which term lengths are compared."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _at_least(normalized: Column, lengths: tuple[int, int]) -> Column:
    any_script, ascii_only = lengths
    # A text of so many code points has as many units or more, so that most texts are settled by the first test.
    plain = normalized.rlike("^[a-z0-9]+\\z")
    return (F.length(normalized) >= ascii_only) | ((utf16_length(normalized) >= any_script) & ~plain)


def is_safe_term(normalized: Column) -> Column:
    """Long enough to match on its own; the argument is already normalized."""
    return _at_least(normalized, SAFE_TERM_LENGTHS)


def is_safe_token(normalized: Column) -> Column:
    """Long enough to suggest a match for review; the argument is already normalized."""
    return _at_least(normalized, SAFE_TOKEN_LENGTHS)


def present(texts: Column) -> Column:
    """Drop NULL and empty elements."""
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def catalog_terms(*arrays: Column) -> Column:
    """All usable terms of a catalog entry in order: NULLs, empties and repeats removed."""
    filled = [F.coalesce(a, F.array().cast("array<string>")) for a in arrays]
    return F.array_distinct(present(F.flatten(F.array(*filled))))


def split_tokens(nfkc_terms: Column) -> Column:
    """Cut NFKC terms at whitespace and punctuation, none of which a piece holds; distinct, order kept."""
    pieces = F.flatten(F.transform(nfkc_terms, lambda t: F.split(t, f"[{SPACE}{STRIPPED}]+")))
    return F.filter(F.array_distinct(pieces), lambda t: t != "")


def weak_tokens(terms: Column) -> Column:
    """Tokens of a catalog entry's terms that are long enough to suggest a match."""
    # Tokens hold nothing that normalization would strip, only upper case.
    return F.filter(split_tokens(nfkc_array(terms)), lambda t: is_safe_token(F.lower(t)))


def safe_terms(terms: Column) -> Column:
    """Trimmed distinct terms that are safe to match on their own."""
    pairs = F.arrays_zip(terms.alias("term"), normalize_array(terms).alias("norm"))
    kept = F.filter(pairs, lambda p: is_safe_term(p["norm"]))
    return F.array_distinct(F.transform(kept, lambda p: trim_space(p["term"])))
