"""Landed JSON payloads of the public statistics interface, mapped to rows.

A landing folder holds one response per line. ``read_payloads`` reads it with a fixed schema;
``parse_payloads`` does the same for responses held in a text column. Both give one row per
item, and the mappers below turn items into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from risemeter.functions.content import parse_duration
from risemeter.functions.misc import PAGE_ADDRESS, best_thumbnail, optional_number

_THUMBNAILS = "thumbnails: STRUCT<high: STRUCT<url: STRING>, medium: STRUCT<url: STRING>, default: STRUCT<url: STRING>>"

ENTITY_ITEM = (
    f"id: STRING, snippet: STRUCT<title: STRING, publishedAt: STRING, description: STRING, {_THUMBNAILS}>, "
    "statistics: STRUCT<subscriberCount: STRING, viewCount: STRING, videoCount: STRING, hiddenSubscriberCount: BOOLEAN>"
)
UPLOAD_ITEM = (
    f"snippet: STRUCT<title: STRING, publishedAt: STRING, resourceId: STRUCT<videoId: STRING>, {_THUMBNAILS}>"
)
VIDEO_ITEM = (
    "id: STRING, statistics: STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>, "
    "contentDetails: STRUCT<duration: STRING>, snippet: STRUCT<liveBroadcastContent: STRING>, "
    "liveStreamingDetails: STRUCT<actualStartTime: STRING, actualEndTime: STRING, scheduledStartTime: STRING, "
    "scheduledEndTime: STRING>"
)
SEARCH_ITEM = (
    "id: STRUCT<videoId: STRING>, snippet: STRUCT<channelId: STRING, channelTitle: STRING, title: STRING, publishedAt: STRING>"
)


def _response(item_fields: str) -> str:
    return f"items ARRAY<STRUCT<{item_fields}>>"


def read_payloads(spark: SparkSession, path: str, item_schema: str, extra: str = "") -> DataFrame:
    """One row per item of the responses in a landing folder; ``extra`` names further response fields."""
    schema = ", ".join(filter(None, [_response(item_schema), extra]))
    return spark.read.schema(schema).json(path).withColumn("item", F.explode("items")).drop("items")


def parse_payloads(rows: DataFrame, column: str, item_schema: str) -> DataFrame:
    """The same for responses held as text; unreadable responses give no items."""
    parsed = F.from_json(F.col(column), _response(item_schema))
    return rows.withColumn("item", F.explode(parsed["items"])).drop(column)


def _others(items: DataFrame) -> list[str]:
    return [c for c in items.columns if c != "item"]


def _count(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0))


def entity_stats(items: DataFrame) -> DataFrame:
    """Counters per entity; missing counters are 0."""
    snippet, statistics = F.col("item.snippet"), F.col("item.statistics")
    return items.select(
        *_others(items),
        F.col("item.id").alias("external_id"),
        F.coalesce(snippet["title"], F.lit("Unknown")).alias("name"),
        best_thumbnail(snippet["thumbnails"]).alias("thumbnail_url"),
        _count(statistics["subscriberCount"]).alias("subscriber_count"),
        _count(statistics["viewCount"]).alias("view_count"),
        _count(statistics["videoCount"]).alias("video_count"),
    )


def uploads(items: DataFrame) -> DataFrame:
    """Recent items of an upload list."""
    snippet = F.col("item.snippet")
    return items.select(
        *_others(items),
        snippet["resourceId"]["videoId"].alias("item_id"),
        F.coalesce(snippet["title"], F.lit("")).alias("title"),
        snippet["publishedAt"].alias("published_at"),
        best_thumbnail(snippet["thumbnails"]).alias("thumbnail_url"),
    )


def item_stats(items: DataFrame) -> DataFrame:
    """Counters, duration and live details per item."""
    statistics = F.col("item.statistics")
    return items.select(
        *_others(items),
        F.col("item.id").alias("item_id"),
        _count(statistics["viewCount"]).alias("view_count"),
        _count(statistics["likeCount"]).alias("like_count"),
        _count(statistics["commentCount"]).alias("comment_count"),
        parse_duration(F.col("item.contentDetails.duration")).alias("duration_seconds"),
        F.col("item.snippet.liveBroadcastContent").alias("live_flag"),
        F.col("item.liveStreamingDetails").alias("live_details"),
    )


def search_hits(items: DataFrame) -> DataFrame:
    """Search hits; rows without an item or entity id are dropped."""
    snippet = F.col("item.snippet")
    hits = items.select(
        *_others(items),
        F.col("item.id.videoId").alias("item_id"),
        snippet["channelId"].alias("external_id"),
        snippet["channelTitle"].alias("entity_title"),
        F.coalesce(snippet["title"], F.lit("")).alias("title"),
        F.coalesce(snippet["publishedAt"], F.lit("")).alias("published_at"),
    )
    return hits.where((F.col("item_id") != "") & (F.col("external_id") != "")).withColumn(
        "item_url", F.concat(F.lit(PAGE_ADDRESS + "watch?v="), "item_id")
    )


def entity_details(items: DataFrame) -> DataFrame:
    """Discovery details; a hidden or unreadable subscriber count is NULL."""
    snippet, statistics = F.col("item.snippet"), F.col("item.statistics")
    hidden = F.coalesce(statistics["hiddenSubscriberCount"], F.lit(False))
    return items.select(
        *_others(items),
        F.col("item.id").alias("external_id"),
        F.coalesce(snippet["title"], F.lit("Unknown")).alias("title"),
        F.concat(F.lit(PAGE_ADDRESS + "channel/"), F.col("item.id")).alias("entity_url"),
        best_thumbnail(snippet["thumbnails"]).alias("thumbnail_url"),
        F.when(~hidden, optional_number(statistics["subscriberCount"])).alias("subscriber_count"),
        F.coalesce(optional_number(statistics["viewCount"]), F.lit(0)).alias("view_count"),
        F.coalesce(optional_number(statistics["videoCount"]), F.lit(0)).alias("video_count"),
        snippet["publishedAt"].alias("published_at"),
        F.coalesce(snippet["description"], F.lit("")).alias("description"),
    )
