"""URL filter: rules looked up in a Bloom filter cascade, in DataFrame functions only.

A cascade holds a list of keys so that, for every key that occurs in the corpus, the answer is exact, and no join is needed to ask. Level 0 is
a Bloom filter of the listed keys. Level 1 holds those keys of the corpus that level 0 takes in wrongly, level 2 the listed keys that level 1 takes in
wrongly, and so on until a level is wrong about none. A key is listed if the first level that does not hold it is an odd one (or, if all hold it,
if the number of levels is odd).

Sizes: with n listed and u corpus keys level 0 has an error rate of n / (sqrt(2) u), so it takes in about as many corpus keys as are listed; all further levels
have a rate of 1/2. A cascade so takes about 1.44 n (log2(u / n) + 3) bits and is bounded by the list, whatever the corpus. It travels as binary
literals. A list whose cascade would pass ``MOST_BYTES`` raises an error; split such a list and ask the parts in turn.

Keys of a url are its host's last labels joined with the beginning of its path, for each (number of labels, length of path) that occurs among the rules; so
their number does not grow with the url. The longest listed key is the rule. Urls without a rule are blocked if a word of their host is listed
(``LISTED_WORDS``, a cascade of its own), else allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; null ids and repeated rows are kept; of two
rules of equal length the one with the longer host wins, and block wins over allow for one key; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from risemeter.llm.tables import saved

MOST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the given rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of hosts that are blocked where no rule fits.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "warez")


@dataclass(frozen=True)
class Level:
    """A Bloom filter: bits as bytes, and the number of its hashes."""

    bits: bytes
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for place in places(key, 8 * len(self.bits), self.hashes, self.seed):
            byte = F.conv(F.hex(F.substring(F.lit(bytearray(self.bits)), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.call_function("getbit", byte, (place % 8).cast("int")) == 1)
        return out


def places(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    """The bits of a key."""
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(size)) for k in range(hashes)]


def build_level(keys: DataFrame, rate: float, seed: int) -> Level | None:
    """The filter of the distinct ``key`` values; None if there are none."""
    n = keys.distinct().count()
    if not n:
        return None
    hashes = max(1, round(-math.log2(rate)))
    size = max(1, math.ceil(n * hashes / math.log(2) / 8))
    if size > MOST_BYTES:
        raise ValueError(f"a filter of {n} keys takes {size} bytes; split the list")
    bits = keys.select(F.explode(F.array(*places(F.col("key"), 8 * size, hashes, seed))).alias("place"))
    rows = bits.groupBy(F.floor(F.col("place") / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("place") % 8).cast("int"))).alias("value"))
    held = bytearray(size)
    for r in rows.collect():  # at most one row per byte of the filter
        held[r["byte"]] = r["value"]
    return Level(bytes(held), hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the ``key`` values of ``listed``, exact for all of ``universe`` (key, repeated keys allowed)."""
    n, u = listed.count(), universe.count()
    if not n:
        return []
    levels = [build_level(listed, min(0.5, n / (math.sqrt(2) * max(1, u))), 0)]
    right = listed.select("key").distinct()
    wrong = saved(universe.where(levels[0].holds(F.col("key"))).distinct().join(right, "key", "left_anti"), "wrong")
    while level := build_level(wrong, 0.5, len(levels)):
        levels.append(level)
        wrong, right = right.where(level.holds(F.col("key"))), wrong
    return levels


def listed_in(levels: list[Level], key: Column) -> Column:
    """Whether ``key``, a key of the universe, is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[k].holds(key), F.lit(k % 2 == 1)).otherwise(out)
    return out


def parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row."""
    url = F.coalesce("url", F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    split = pages.select("page_id", rest.alias("rest"))
    host = F.regexp_extract("rest", r"^([^/?#]*)", 1)
    return split.select("page_id", F.translate(host, UPPER, LOWER).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_keys(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The keys of a row of ``parts`` that a rule could have."""
    shapes = sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})
    keys = [F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)) for labels, length in shapes]
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(*keys)) if keys else F.array().cast("array<string>"))


def host_words() -> Column:
    return F.array_distinct(F.split("host", "[^a-z0-9]+"))


def url_verdicts(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed_words: tuple[str, ...] = LISTED_WORDS
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    spark = pages.sparkSession
    keyed = parts(pages).withColumn("keys", rule_keys(rules)).withColumn("words", host_words())
    universe = keyed.select(F.explode("keys").alias("key"))

    def cascade(keys: list[str], corpus: DataFrame) -> list[Level]:
        listed = spark.range(1 if keys else 0).select(F.explode(F.array(F.lit(""), *map(F.lit, keys))).alias("key")).where("key <> ''")
        return build_cascade(listed, corpus)

    block = cascade([host + path for verdict, host, path in rules if verdict == "block"], universe)
    allow = cascade([host + path for verdict, host, path in rules if verdict == "allow"], universe)
    words = cascade(list(listed_words), keyed.select(F.explode("words").alias("key")))
    fits = F.filter("keys", lambda k: listed_in(block, k) | listed_in(allow, k))
    host_size = lambda k: F.length(F.substring_index(k, "/", 1))
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("size"), host_size(k).alias("host_size"), k.alias("key"))))
    ruled = keyed.select("page_id", "host", "path", "words", best["key"].alias("rule"))
    verdict = (
        F.when(F.col("rule").isNull(), F.when(F.exists("words", lambda w: listed_in(words, w)), "block").otherwise("allow"))
        .when(listed_in(block, F.col("rule")), "block")
        .otherwise("allow")
    )
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
