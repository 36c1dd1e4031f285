"""Personal data by weak supervision, in DataFrame functions only.

**Base spans** of the kinds ``email``, ``ip``, ``card`` and ``phone`` are always kept. The patterns are written so that Java's matcher neither recurses nor
backtracks over long runs, and find what the plain forms find.

**Candidates** beyond them are looser forms: ``name (at) host.tld``, IPv6 addresses, digit groups that a card's check digit rejects, and phone
numbers without ``+``. Three kinds of labelers vote on every span, base ones included: *regex* (the strict pattern and its check hold), *gazetteer* (a
known domain ending, card prefix, or dialling shape in the span), *context* (a cue word such as "mail" or "tel" shortly before it; and against it,
a word such as "version" or "order"). A vote is 1, 0 (abstains) or -1.

**Reliabilities.** Expectation-maximisation over the counts of vote patterns - a bounded table, whatever the input - estimates how often
each labeler votes each way on true and on false spans. Its posteriors weight the **span classifier**: naive Bayes over features that the labelers do not
see (length, share of digits, separators, the characters around), again fitted on bounded counts. Base spans are kept; of the candidates those
stay that have more votes for than against them, and whose probability under votes and classifier together reaches ``ACCEPT``.

The texts are read once: what a text holds is written as spans with votes and features, and everything after works on those.

Defined results: a null text counts as empty; candidates that overlap a base span, or an earlier candidate, do not count; null ids are kept;
repeated rows are reported each; further columns are not read. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from risemeter.llm.tables import saved

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
ROUNDS = 30
AROUND = 24

# The patterns of base spans. `\G` lets a match begin where the last one ended, even within a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no base span of the kind.
MARK = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT|@)[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Linear test that a text may hold a base span or a candidate.
ANY = r"[0-9@]|[(\[](?:at|AT)[)\]]"

ENDINGS = r"(?i)\.(?:com|org|net|edu|gov|info|io|[a-z]{2})$"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|from|addr)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|pan|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|contact)\b",
}
AGAINST = {
    "email": r"(?i)\b(?:example|sample)\b",
    "ip": r"(?i)\b(?:version|v|release|section|chapter)\b",
    "card": r"(?i)\b(?:order|isbn|id|serial|invoice|ref|no)\b",
    "phone": r"(?i)\b(?:order|isbn|id|serial|version|ref)\b",
}
VOTES = ("regex", "gazetteer", "context")
FEATURES = ("size", "digits", "breaks", "left", "right")


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, end, span) of the matches of ``pattern``: what lies between two matches and the matches alternate."""
    between, spans = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, span: string>>)").alias("out"))

    def step(seen: Column, x: Column) -> Column:
        begin = seen["at"] + F.length(x["a"])
        end = begin + F.length(x["b"])
        return F.struct(end.alias("at"), F.concat(seen["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["b"].alias("span")))).alias("out"))

    return F.aggregate(F.arrays_zip(between.alias("a"), spans.alias("b")), start, step, lambda x: F.filter(x["out"], lambda s: s["span"].isNotNull()))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a run of digits holds."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(place: Column) -> Column:
        x = F.substr(digits, place, F.lit(1)).cast("int")
        return F.when((F.length(digits) - place) % 2 == 0, x).otherwise(x * 2 - F.when(x >= 5, 9).otherwise(0))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(span)).between(13, 19) & _luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    return F.lit(True)


def _holding(kind: str) -> Callable[[Column], Column]:
    return lambda s: _holds(kind, s["span"])


def _of_kind(number: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == number


def _gazetteer(kind: str, span: Column) -> Column:
    known = {
        "email": span.rlike(ENDINGS),
        "ip": ~span.rlike(r"^(?:0|255)\."),
        "card": _digits(span).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"),
        "phone": span.rlike(r"^(?:\+[1-9]|\([2-9])"),
    }
    return F.when(known[kind], 1).otherwise(-1)


def _context(kind: str, before: Column) -> Column:
    return F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST[kind]), -1).otherwise(0)


def _class(char: Column) -> Column:
    return F.when(char == "", "end").when(char.rlike(r"^\s$"), "blank").when(char.rlike("^[0-9]$"), "digit").when(char.rlike(r"^\p{L}$"), "letter").otherwise("mark")


def _judged(text: Column, kind: str, spans: Column, strict: int) -> Column:
    """Places, votes and features of spans."""

    def judge(s: Column) -> Column:
        lead = F.least(s["start"], F.lit(AROUND))
        before = F.substr(text, s["start"] - lead + 1, lead)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(strict).alias("regex"),
            _gazetteer(kind, s["span"]).alias("gazetteer"),
            _context(kind, before).alias("context"),
            F.least(F.lit(9), F.floor(F.length(s["span"]) / 4)).cast("string").alias("size"),
            F.floor(4 * F.length(_digits(s["span"])) / F.length(s["span"])).cast("string").alias("digits"),
            F.least(F.lit(5), F.length(F.regexp_replace(s["span"], "[A-Za-z0-9]", ""))).cast("string").alias("breaks"),
            _class(F.when(s["start"] > 0, F.substr(text, s["start"], F.lit(1))).otherwise("")).alias("left"),
            _class(F.substr(text, s["end"] + 1, F.lit(1))).alias("right"),
        )

    return F.transform(spans, judge)


def judged_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose): the spans of every text with places, votes and features."""
    text = F.col("text")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, span: string>>)")
    gated = {k: F.when(text.rlike(ANY) & text.rlike(MARK[k]), _found(text, BASE[k])).otherwise(empty).alias(f"strict_{k}") for k in KINDS}
    loose = {k: F.when(text.rlike(ANY) & text.rlike(p), _found(text, p)).otherwise(empty).alias(f"loose_{k}") for k, p in LOOSE.items()}
    found = some.select("doc_id", "text", *gated.values(), *loose.values())
    held = {k: F.filter(f"strict_{k}", _holding(k)) for k in KINDS}
    rejected = F.filter("strict_card", lambda s: F.length(_digits(s["span"])).between(13, 19) & ~_luhn(_digits(s["span"])))
    base = F.concat(*[_judged(text, k, held[k], 1) for k in KINDS])
    more = F.concat(_judged(text, "email", F.col("loose_email"), 0), _judged(text, "ip", F.col("loose_ip"), 0), _judged(text, "card", rejected, -1), _judged(text, "phone", F.col("loose_phone"), 0))
    return found.select("doc_id", base.alias("base"), more.alias("more")).select("doc_id", "base", _apart("base", "more").alias("loose"))


def _apart(base: str, more: str) -> Column:
    """The candidates that overlap no base span and no candidate before them."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter(more, lambda s: ~F.exists(base, lambda t: meets(s, t)))
    first = F.filter(free, lambda s: ~F.exists(more, lambda t: meets(s, t) & (F.struct(t["start"], t["kind"]) < F.struct(s["start"], s["kind"]))))
    return F.when(F.size(more) == 0, F.col(more)).otherwise(first)


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation on (kind, votes, count) rows: the probability that a span with these votes is true."""
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in {k for k, *_ in patterns}:
        own = [(votes, n) for k, votes, n in patterns if k == kind]
        share = 0.5
        chance = {True: [{1: 0.7, 0: 0.2, -1: 0.1} for _ in VOTES], False: [{1: 0.1, 0: 0.2, -1: 0.7} for _ in VOTES]}
        chance[True][2], chance[False][2] = {1: 0.3, 0: 0.65, -1: 0.05}, {1: 0.05, 0: 0.65, -1: 0.3}
        belief: dict[tuple[int, ...], float] = {}
        for _ in range(rounds):
            for votes, _n in own:
                yes = share * math.prod(c[v] for c, v in zip(chance[True], votes, strict=True))
                no = (1 - share) * math.prod(c[v] for c, v in zip(chance[False], votes, strict=True))
                belief[votes] = yes / (yes + no)
            total = sum(n for _, n in own)
            share = min(0.99, max(0.01, (sum(n * belief[v] for v, n in own) + 1) / (total + 2)))
            for truth in (True, False):
                for j in range(len(VOTES)):
                    # The start counts as ten spans, so that a few spans do not overturn what the votes mean.
                    prior = {1: 7.0, 0: 2.0, -1: 1.0} if truth else {1: 1.0, 0: 2.0, -1: 7.0}
                    weight = {v: prior[v] + sum(n * (belief[p] if truth else 1 - belief[p]) for p, n in own if p[j] == v) for v in (1, 0, -1)}
                    chance[truth][j] = {v: w / sum(weight.values()) for v, w in weight.items()}
        out |= {(kind, votes): p for votes, p in belief.items()}
    return out


def _looked_up(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def _pattern(s: Column) -> Column:
    return F.concat_ws("|", *[s[c].cast("string") for c in ("kind", *VOTES)])


def _feature(s: Column, name: str) -> Column:
    return F.concat_ws("|", s["kind"].cast("string"), F.lit(name), s[name])


def personal_spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) of every row.

    Counts and digest are those of the base spans; ``spans`` is all of them as text, ``found`` as an array of structs.
    """
    judged = saved(judged_spans(docs), "spans")
    every = judged.select(F.explode(F.concat("base", "loose")).alias("s"))
    counted = every.groupBy("s.kind", *[f"s.{v}" for v in VOTES]).count().collect()
    belief = reliabilities([(r.kind, tuple(r[v] for v in VOTES), r["count"]) for r in counted])
    table = {"|".join(map(str, (kind, *votes))): p for (kind, votes), p in belief.items()}
    trust = _looked_up(table, _pattern(F.col("s")), 0.5)
    cells = every.select(trust.alias("p"), F.explode(F.array(*[_feature(F.col("s"), f) for f in FEATURES])).alias("cell"))
    # One row per kind, feature and value.
    sums = cells.groupBy("cell").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    totals: dict[str, tuple[float, float]] = {}
    for r in sums:
        group = r.cell.rpartition("|")[0]
        yes, no = totals.get(group, (0.0, 0.0))
        totals[group] = (yes + r.yes, no + r.no)
    ratios = {r.cell: math.log((r.yes + 1) / (totals[r.cell.rpartition("|")[0]][0] + 10)) - math.log((r.no + 1) / (totals[r.cell.rpartition("|")[0]][1] + 10)) for r in sums}

    def accepted(s: Column) -> Column:
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), _looked_up(table, _pattern(s), 0.5)))
        logit = F.log(p / (1 - p))
        for f in FEATURES:
            logit = logit + _looked_up(ratios, _feature(s, f), 0.0) / len(FEATURES)
        votes = s["regex"] + s["gazetteer"] + s["context"]
        return (votes > 0) & (p >= 0.5) & (1 / (1 + F.exp(-logit)) >= accept)

    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    kept = judged.select("doc_id", F.transform("base", place).alias("base"), F.transform(F.filter("loose", accepted), place).alias("extra"))
    names = F.array(*[F.lit(k) for k in KINDS])
    label = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    written = lambda spans: F.array_join(F.transform(spans, label), ",")
    every = F.array_sort(F.concat("base", "extra"))
    return kept.select(
        "doc_id",
        *[F.size(F.filter("base", _of_kind(j))).cast("long").alias(f"n_{k}") for j, k in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(every).alias("spans"),
        F.transform(every, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )
