"""The weekly digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from risemeter.operators.ranking import top
from risemeter.operators.snapshots import latest_vs_first
from risemeter.operators.tallies import buzz_totals
from risemeter.sources.tables import active_entities

# The digest's texts.
TITLE = "{week}週 パチスロ系YouTuber推移＆新台バズまとめ"
INTRODUCTION = (
    "この記事はチャンネル登録者数・再生数の推移データから自動生成しています。"
    "攻略・期待値・立ち回りの情報は含みません。"
)
HEADINGS = {
    "rising": "## 登録者数 急上昇チャンネル TOP5",
    "falling": "## 登録者数 急降下チャンネル TOP5",
    "buzz": "## 新台バズランキング TOP5",
}
NO_GROWTH = "まだ推移データが十分に溜まっていません。"
NO_BUZZ = "まだバズデータが十分に溜まっていません。"
UNKNOWN_MAKER = "メーカー不明"
SECTIONS = ["rising", "falling", "buzz"]


def digest_tops(entities: DataFrame, daily: DataFrame, catalog: DataFrame, mentions: DataFrame) -> DataFrame:
    """The three top-5 tables as (section, position, name, maker, amount, delta).

    Growth is the latest row against the first row ever, and the rising list is not limited to
    gains. Each list is a top-k over pre-aggregated rows; positions are given to its five rows.
    """
    change = active_entities(entities).select("entity_id", "name").join(
        latest_vs_first(daily, "entity_id", "subscriber_count"), "entity_id"
    )
    growth = change.select(
        "name", F.lit(None).cast("string").alias("maker"), F.col("latest_value").alias("amount"), "delta",
        F.col("entity_id").alias("_id"),
    )
    buzz = buzz_totals(catalog, mentions).select(
        "name", "maker", F.col("total_views").alias("amount"), F.col("item_count").alias("delta"),
        F.col("catalog_id").alias("_id"),
    )

    def section(name: str, rows: DataFrame, order: list[Column]) -> DataFrame:
        best = top(rows, order)
        position = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
        return best.select(F.lit(name).alias("section"), position.cast("long").alias("position"), "name", "maker", "amount", "delta")

    return (
        section("rising", growth, [F.desc("delta"), F.asc("_id")])
        .unionByName(section("falling", growth, [F.asc("delta"), F.asc("_id")]))
        .unionByName(section("buzz", buzz, [F.desc("amount"), F.asc("_id")]))
    )


def weekly_digest(tops: DataFrame, week_of: str) -> DataFrame:
    """One row (week_of, title, body_markdown) from at most fifteen top rows."""
    amount = F.format_number("amount", 0)
    delta = F.format_number("delta", 0)
    signed = F.concat(F.when(F.col("delta") >= 0, "+").otherwise(""), delta)
    number = F.concat(F.col("position").cast("string"), F.lit(". **"), F.col("name"), F.lit("**"))
    line = (
        F.when(F.col("section") == "rising", F.concat(number, F.lit(" — 現在"), amount, F.lit("人 ("), signed, F.lit(")")))
        .when(F.col("section") == "falling", F.concat(number, F.lit(" — 現在"), amount, F.lit("人 ("), delta, F.lit(")")))
        .otherwise(
            F.concat(
                number, F.lit("("), F.coalesce("maker", F.lit(UNKNOWN_MAKER)), F.lit(") — 合計再生数"), amount,
                F.lit("・関連動画"), F.col("delta").cast("string"), F.lit("本"),
            )
        )
    )
    lines = tops.withColumn("line", line)

    def listed(section: str, empty: str, shown: Column) -> Column:
        chosen = F.sort_array(
            F.collect_list(F.when(F.col("section") == section, F.struct("position", "line")))
        )
        text = F.array_join(F.transform(chosen, lambda row: row["line"]), "\n")
        return F.when(shown, text).otherwise(F.lit(empty)).alias(section)

    any_of = {s: F.count_if(F.col("section") == s) > 0 for s in SECTIONS}
    any_views = F.coalesce(F.bool_or((F.col("section") == "buzz") & (F.col("amount") != 0)), F.lit(False))
    texts = lines.agg(
        listed("rising", NO_GROWTH, any_of["rising"]),
        listed("falling", NO_GROWTH, any_of["falling"]),
        listed("buzz", NO_BUZZ, any_views),
    )
    title = TITLE.format(week=week_of)
    parts = [F.lit(f"# {title}\n\n{INTRODUCTION}\n")]
    for at, section in enumerate(SECTIONS):
        parts.append(F.concat(F.lit(HEADINGS[section] + "\n\n"), F.col(section), F.lit("" if at == 2 else "\n")))
    return texts.select(
        F.lit(week_of).alias("week_of"), F.lit(title).alias("title"), F.concat_ws("\n", *parts).alias("body_markdown")
    )


def digest_list(digests: DataFrame) -> DataFrame:
    return digests.select("week_of", "title").orderBy(F.desc("week_of"))
