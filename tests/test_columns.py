"""Column expressions on literal vectors."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from risemeter.functions import content, dates, identity, judgments, misc, numbers, text as T


def values(spark, column, data, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i INT, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fixed_matches_exact_decimal_rounding(spark):
    random.seed(7)
    data = [random.randint(-5000, 5000) / random.randint(1, 9000) * 100 for _ in range(2000)]
    data += [0.575, 1.005, 0.125, 0.375, -0.125, 2.5, 1234567.885, 0.0, -0.001]

    def exact(x):
        rounded = decimal.Decimal(x).quantize(decimal.Decimal("0.01"), rounding=decimal.ROUND_HALF_UP)
        return float(rounded) + 0.0

    assert values(spark, lambda c: numbers.fixed(c, 2), data, "DOUBLE") == [exact(x) for x in data]


def test_percent_guards_zero(spark):
    df = spark.createDataFrame([(20, 100), (1, 3), (5, 0)], "d BIGINT, b BIGINT")
    got = [r[0] for r in df.select(numbers.delta_percent(F.col("d"), F.col("b"))).collect()]
    assert got == [20.0, 33.33, 0.0]


def test_normalize_text(spark):
    data = ["新台　ブルーロック　ｌｉｇｈｔ　ｖｅｒ．", "A・B-C_(D)[E]【F】「G」『H』", None, "", "ﾊﾟﾁﾝｺ ﻿x"]
    assert values(spark, T.normalize_text, data, "STRING") == ["新台ブルーロックlightver.", "abcdefgh", None, "", "パチンコx"]


def test_safe_terms(spark):
    data = ["海", "北斗の拳", "abc12", "abc123", "番長4", "𠮷𠮷"]
    assert values(spark, lambda c: T.is_safe_term(T.normalize_text(c)), data, "STRING") == [False, True, False, True, False, True]
    assert values(spark, lambda c: T.is_safe_token(T.normalize_text(c)), data, "STRING") == [False, True, True, True, True, True]


def test_tokens_and_terms(spark):
    df = spark.createDataFrame([(["Ｐ海物語 極JAPAN・改", "海", None, "海"],)], "t ARRAY<STRING>")
    row = df.select(
        T.weak_tokens(F.filter("t", lambda t: t.isNotNull())).alias("w"), T.catalog_terms(F.col("t")).alias("c"), T.normalize_array(F.col("t")).alias("n")
    ).first()
    assert row.w == ["P海物語", "極JAPAN"]
    assert row.c == ["Ｐ海物語 極JAPAN・改", "海"]


def test_names_and_makers(spark):
    names = ["ぱちんこ 必殺仕事人Ⅵ", "ぱちんこ必殺仕事人6", "Rocky II / iii", "v and vi", "Civil"]
    assert values(spark, identity.normalize_name, names, "STRING") == ["ぱちんこ必殺仕事人6", "ぱちんこ必殺仕事人6", "rocky23", "vand6", "civil"]
    makers = ["オッケー.", "おっけー", "京楽", "SANKYO", None, ""]
    assert values(spark, identity.normalize_maker, makers, "STRING") == ["おっけー", "おっけー", "京楽産業", "sankyo", "", ""]


def test_types(spark):
    data = ["pachinko", " パチンコ ", "ﾊﾟﾁｽﾛ", "PACHISLOT", "スロット", "video", "", None]
    assert values(spark, identity.normalize_type, data, "STRING") == [
        "pachinko", "pachinko", "slot", "slot", "slot", None, None, None
    ]
    df = spark.createDataFrame(
        [("Slot ", "x"), (None, "デカスタeベルセルク無双 第2章"), (None, "other"), ("ball", "x")], "t STRING, n STRING"
    )
    got = [r[0] for r in df.select(identity.migrate_type(F.col("t"), F.col("n"))).collect()]
    assert got == ["slot", "pachinko", None, "ball"]


def test_identity_keys(spark):
    rows = [
        ("ぱちんこ 必殺仕事人VI オッケー", None, "パチンコ", dt.date(2026, 7, 6)),
        ("ぱちんこ 必殺仕事人Ⅵ", "オッケー.", "pachinko", dt.date(2026, 7, 6)),
        ("Machine A", "Maker", "slot", dt.date(2026, 1, 1)),
        ("Machine A", "Maker", "slot", dt.date(2026, 2, 1)),
        ("Machine A", "Maker", None, None),
    ]
    df = spark.createDataFrame(rows, "name STRING, maker STRING, type STRING, release_date DATE")
    reviewed = spark.createDataFrame(
        [("ぱちんこ 必殺仕事人VI オッケー", "ぱちんこ 必殺仕事人VI", "オッケー.")],
        "alias STRING, canonical_name STRING, canonical_maker STRING",
    )
    keys = [r.identity_key for r in identity.with_identity_key(df, reviewed).orderBy(F.desc("name"), "release_date").collect()]
    assert "machinea|maker||" in keys and "machinea|maker|slot|2026-01-01" in keys
    assert keys.count("ぱちんこ必殺仕事人6|おっけー|pachinko|2026-07-06") == 2


def test_durations(spark):
    data = ["PT1H2M3S", "PT45S", "PT2H", "PT", "P1DT1H", "1:20", "", None, "PT1M\n"]
    assert values(spark, content.parse_duration, data, "STRING") == [3723, 45, 7200, 0, None, None, None, None, None]


STARTED = "2026-07-01T12:00:00Z"
CASES = [
    # title, duration, flag, started, ended, scheduled, category, existing -> type
    ("【WebCM】L聖闘士黄金十二宮 #shorts", 15, None, None, None, None, "manufacturer", None, "promotion"),
    ("マルハン東日本カンパニーCM「週末スイッチ」篇", 30, None, None, None, None, "hall", None, "promotion"),
    ("PVを引いた実戦", None, None, None, None, None, "individual", None, "standard"),
    ("CM中に起きた話", 600, None, None, None, None, "individual", None, "standard"),
    ("実況配信", None, "live", None, None, None, None, None, "live"),
    ("配信予定", None, "Upcoming", None, None, None, None, None, "live"),
    ("通常番組収録", 120, "none", STARTED, None, None, None, None, "standard"),
    ("通常番組収録", 120, "none", None, STARTED, None, None, None, "standard"),
    ("公式 WebCM", None, None, STARTED, None, None, "manufacturer", None, "promotion"),
    ("生配信", None, "none", STARTED, None, None, None, None, "live"),
    ("🔴LIVE", None, "none", STARTED, None, None, None, None, "live"),
    ("配信アーカイブ", None, "none", None, None, STARTED, None, None, "live"),
    ("【歌ってみた】乙女フェスティバル", 303, "none", STARTED, None, None, None, None, "standard"),
    ("生配信切り抜きまとめ", None, "none", None, None, None, None, "live", "live"),
    ("長時間配信アーカイブ #shorts", 27589, "none", STARTED, STARTED, None, None, None, "live"),
    ("生配信の見どころまとめショート", 45, None, None, None, None, None, None, "short"),
    ("生配信の見どころ #shorts", 42, None, None, None, None, None, None, "short"),
    ("生配信の見どころ", 600, "none", STARTED, None, None, None, None, "standard"),
    ("ハラキリドライブ 第10話", 900, None, None, None, None, None, None, "standard"),
    ("ショートST突入からの実戦", 900, None, None, None, None, None, None, "standard"),
    ("ショートST突入 #shorts", 30, None, None, None, None, None, None, "standard"),
    ("スマスロ実践 #shorts", 120, None, None, None, None, None, None, "short"),
    ("スマスロ実践", 59, None, None, None, None, None, None, "short"),
    ("スマスロ実践", 120, None, None, None, None, None, None, "standard"),
    ("スマスロ実践", 0, None, None, None, None, None, None, "standard"),
    ("", None, None, None, None, None, None, None, "unknown"),
    ("　 ", None, None, None, None, None, None, None, "unknown"),
]


def test_content_classes(spark):
    names = ["title", "duration", "flag", "started", "ended", "scheduled", "category", "existing"]
    df = spark.createDataFrame(
        [(i, *c[:-1]) for i, c in enumerate(CASES)], "i INT, " + ", ".join(f"{n} {'INT' if n == 'duration' else 'STRING'}" for n in names)
    )
    verdict = content.classify_content(*[F.col(n) for n in names])
    got = [r.v.content_type for r in df.select("i", verdict.alias("v")).orderBy("i").collect()]
    assert got == [c[-1] for c in CASES]


def test_judgment_texts(spark):
    responses = [
        'ok [{"candidateIndex": 0, "machineId": 7, "confidence": 0.95, "reason": "r", "matchedTerms": ["a", 1, "b"]}] end',
        '[{"candidateIndex": 1.5, "confidence": 0.9}, {"candidateIndex": 2, "confidence": "0.9"}, {"candidateIndex": 3, "confidence": 1.2}]',
        '[{"candidateIndex": 4, "confidence": 1}, 5, null, {"confidence": 0.3}]',
        "no array", "[broken", None, '{"candidateIndex": 1}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "batch_id INT, response_text STRING")
    got = judgments.parse_judgments(df).orderBy("batch_id", "candidate_index").collect()
    assert [(r.batch_id, r.candidate_index, r.judged_catalog_id, r.confidence, r.reason, r.matched_terms) for r in got] == [
        (0, 0, 7, 0.95, "r", ["a", "b"]),
        (2, 4, None, 1.0, "", []),
    ]


def test_small_rules(spark):
    urls = spark.createDataFrame([("@a", "x"), ("b", None), (None, "c"), (None, None), ("", "d")], "h STRING, e STRING")
    got = [r[0] for r in urls.select(misc.entity_page_url(F.col("h"), F.col("e"))).collect()]
    base = misc.PAGE_ADDRESS
    assert got == [base + "@a", base + "@b", base + "channel/c", None, base + "channel/d"]
    assert values(spark, misc.optional_number, ["12", "", None, "x", " 7 ", "Infinity", "1e3"], "STRING") == [12, None, None, None, 7, None, 1000]
    assert values(spark, misc.is_valid_voter, ["abcdefgh", "short", "has space", "a" * 257, None], "STRING") == [True, False, False, False, False]


def test_days(spark):
    data = [dt.datetime(2026, 7, 16, 14, 59), dt.datetime(2026, 7, 16, 15, 0)]
    assert [str(d) for d in values(spark, dates.local_day, data, "TIMESTAMP")] == ["2026-07-16", "2026-07-17"]
    sunday = [dt.datetime(2026, 7, 19, 23), dt.datetime(2026, 7, 20, 0)]
    assert [str(d) for d in values(spark, dates.monday_of, sunday, "TIMESTAMP")] == ["2026-07-13", "2026-07-20"]


@pytest.mark.parametrize(
    ("published", "expected"),
    [
        ("2026-07-05T23:59:59Z", "pre_release"), ("2026-07-06T00:00:00Z", "first_7_days"), ("2026-07-13T00:00:00Z", "first_7_days"),
        ("2026-07-13T00:00:01Z", "after_release"), ("nonsense", "unclassified"), (None, "unclassified"),
    ],
)
def test_release_buckets(spark, published, expected):
    df = spark.createDataFrame([(published, dt.date(2026, 7, 6))], "p STRING, r DATE")
    assert df.select(dates.release_bucket(F.col("p"), F.col("r"))).first()[0] == expected
    missing = df.select(dates.release_bucket(F.col("p"), F.lit(None).cast("date"))).first()[0]
    assert missing == "unclassified"
