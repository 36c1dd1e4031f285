"""Catalog identity: canonical names, makers, types and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from risemeter.functions.text import SPACE_CHARACTERS, nfkc, trim_space, without_characters

# Numeral words, longest first; a bare "v" has no rule.
ROMAN_NUMERALS = {"vi": 6, "iv": 4, "iii": 3, "ii": 2, "i": 1}
# Punctuation dropped from catalog names and from maker names.
NAME_PUNCTUATION = "・･,，.．:：/／-_()（）「」『』"
MAKER_PUNCTUATION = "・･.．"
# Maker synonyms after normalization.
MAKER_SYNONYMS = {"オッケー": "おっけー", "京楽": "京楽産業"}
# Spellings of the two catalog types.
TYPE_SPELLINGS = {
    "pachinko": ["pachinko", "パチンコ", "ぱちんこ"],
    "slot": ["slot", "pachislot", "pachislo", "パチスロ", "ぱちすろ", "スロット", "パチスロット"],
}
# Name patterns that settle the type of rows without one.
PACHINKO_NAME_PATTERNS = [
    "eフィーバー%デッドマウント%デスプレイ%魂神%",
    "ぱちんこ 必殺仕事人VI%",
    "デカスタeベルセルク無双%",
]


def normalize_name(name: Column) -> Column:
    """Lower-case NFKC name with standing roman numerals as digits and punctuation removed."""
    out = F.lower(nfkc(name))
    for numeral, digit in ROMAN_NUMERALS.items():
        out = F.regexp_replace(out, f"(^|[^a-z]){numeral}([^a-z]|\\z)", f"$1{digit}$2")
    return without_characters(out, SPACE_CHARACTERS + NAME_PUNCTUATION)


def normalize_maker(maker: Column) -> Column:
    """Maker without spacing and dots, synonyms folded; NULL and empty become empty."""
    plain = without_characters(F.lower(nfkc(maker)), SPACE_CHARACTERS + MAKER_PUNCTUATION)
    out = plain
    for variant, chosen in MAKER_SYNONYMS.items():
        out = F.when(plain == variant, F.lit(chosen)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def normalize_type(value: Column) -> Column:
    """pachinko / slot, or NULL for any other spelling."""
    plain = F.lower(trim_space(nfkc(value)))
    return F.when(plain.isin(TYPE_SPELLINGS["pachinko"]), "pachinko").when(
        plain.isin(TYPE_SPELLINGS["slot"]), "slot"
    )


def migrate_type(value: Column, name: Column) -> Column:
    """Stored-type migration: known spellings folded, NULL filled from the name, the rest unchanged."""
    plain = F.lower(F.trim(value))
    by_name = F.lit(False)
    for pattern in PACHINKO_NAME_PATTERNS:
        by_name = by_name | name.like(pattern)
    return (
        F.when(plain.isin(TYPE_SPELLINGS["slot"]), "slot")
        .when(plain.isin(TYPE_SPELLINGS["pachinko"]), "pachinko")
        .when(value.isNull() & by_name, "pachinko")
        .otherwise(value)
    )


def with_identity_key(catalog: DataFrame, reviewed_aliases: DataFrame | None = None) -> DataFrame:
    """Add ``identity_key`` = name|maker|type|date to (name, maker, type, release_date) rows.

    ``reviewed_aliases`` (alias, canonical_name, canonical_maker) redirects listed spellings
    to their canonical entry before the key is built. The lookup is an equi join on the
    normalized spelling; Spark broadcasts it while it is small by its own statistics.
    """
    plain = catalog.withColumn("_name", normalize_name(F.col("name")))
    name, maker = F.col("_name"), F.col("maker")
    if reviewed_aliases is not None:
        # A canonical name leads to its own canonical maker, as its aliases do.
        own = F.col("canonical_name").alias("alias")
        listed = reviewed_aliases.select("alias", "canonical_name", "canonical_maker")
        listed = listed.unionByName(reviewed_aliases.select(own, "canonical_name", "canonical_maker"))
        lookup = listed.select(
            normalize_name(F.col("alias")).alias("_alias"),
            F.struct(
                normalize_name(F.col("canonical_name")).alias("name"), F.col("canonical_maker").alias("maker")
            ).alias("_canonical"),
        )
        lookup = lookup.groupBy("_alias").agg(F.min("_canonical").alias("_canonical"))
        plain = plain.join(lookup, F.col("_name") == F.col("_alias"), "left")
        name = F.coalesce(F.col("_canonical.name"), name)
        maker = F.coalesce(F.col("_canonical.maker"), maker)
    key = F.concat_ws(
        "|",
        name,
        normalize_maker(maker),
        F.coalesce(normalize_type(F.col("type")), F.lit("")),
        F.coalesce(F.col("release_date").cast("string"), F.lit("")),
    )
    return plain.withColumn("identity_key", key).drop("_name", "_alias", "_canonical")
