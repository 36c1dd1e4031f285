"""Content classes of items and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from risemeter.functions.text import SPACE, trim_space

# The content types, the rankable ones, and the categories that publish promotions.
CONTENT_TYPES = ["standard", "short", "live", "promotion", "unknown"]
RANKABLE_TYPES = ["standard", "short", "live"]
OFFICIAL_CATEGORIES = ["manufacturer", "hall", "media"]
CATEGORIES = ["media", "performer", "individual", "manufacturer", "hall", "other"]

# Title patterns, with S standing for one whitespace character and A for any but a line end.
STRONG_PROMOTION = [
    "webS*cm",
    "公式S*pv",
    "プロモーション",
    "ティザー",
    "機種公式映像",
    "公式映像",
]
BOUNDED_PROMOTION = ["(^|[^a-z0-9])cm([^a-z0-9]|\\z)", "(^|[^a-z0-9])pv([^a-z0-9]|\\z)"]
LIVE_RELATED_CLIP = [
    "生配信A*(見どころ|みどころ|まとめ|切り抜き|切抜|ダイジェスト)",
    "(見どころ|みどころ|まとめ|切り抜き|切抜|ダイジェスト)A*生配信",
    "歌ってみた",
    "ライブ実戦",
    "ハラキリS*drive",
    "ハラキリドライブ",
]
LIVE_TITLE = ["生配信", "ライブ配信", "生放送", "実機配信", "🔴S*live", "配信アーカイブ"]
SHORTS_TAG = "(^|[S#])#?shorts?(S|\\z)"
SHORT_MODE_NAME = "ショートS*st"


def _pattern(*texts: str) -> str:
    """One pattern for any of the listed ones, so that a title is passed over once per list."""
    parts = [
        t.replace("[S", f"[{SPACE}").replace("S", f"[{SPACE}]").replace("A*", "[^\\n\\r\\u2028\\u2029]*") for t in texts
    ]
    return "(?i)" + "|".join(f"(?:{part})" for part in parts)


def _any(title: Column, patterns: list[str]) -> Column:
    return title.rlike(_pattern(*patterns))


def _class(content_type: str, reason: Column | str, confidence: int) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        F.lit(content_type).alias("content_type"),
        reason.alias("reason"),
        F.lit(confidence).alias("confidence"),
    )


def classify_content(
    title: Column,
    duration_seconds: Column,
    live_flag: Column,
    started_at: Column,
    ended_at: Column,
    scheduled_at: Column,
    category: Column,
    existing_type: Column,
) -> Column:
    """Rule cascade promotion > live > short > standard as struct(content_type, reason, confidence)."""
    text = trim_space(F.coalesce(title, F.lit("")))
    flag = F.lower(live_flag)
    official = F.coalesce(category.isin(OFFICIAL_CATEGORIES), F.lit(False))
    broadcast = F.coalesce(
        F.nullif(started_at, F.lit("")), F.nullif(ended_at, F.lit("")), F.nullif(scheduled_at, F.lit(""))
    ).isNotNull()
    not_short_mode = ~text.rlike(_pattern(SHORT_MODE_NAME))
    return (
        F.when(text == "", _class("unknown", "missing title", 0))
        .when(
            official & _any(text, STRONG_PROMOTION),
            _class("promotion", "official channel with strong promotional title signal", 90),
        )
        .when(
            official & _any(text, BOUNDED_PROMOTION),
            _class("promotion", "official channel with bounded CM/PV title signal", 90),
        )
        .when(
            flag.isin("live", "upcoming"),
            _class("live", F.concat(F.lit("youtube liveBroadcastContent="), flag), 95),
        )
        .when(
            existing_type == "live",
            _class("live", "existing live classification retained because live metadata is inconclusive", 95),
        )
        .when(
            broadcast & ~_any(text, LIVE_RELATED_CLIP) & _any(text, LIVE_TITLE),
            _class("live", "youtube broadcast timestamp plus explicit live title signal", 95),
        )
        .when(not_short_mode & text.rlike(_pattern(SHORTS_TAG)), _class("short", "shorts title hashtag", 75))
        .when(
            not_short_mode & (duration_seconds > 0) & (duration_seconds <= 60),
            _class("short", "duration is 60 seconds or less", 75),
        )
        .otherwise(_class("standard", "default long-form classification", 60))
    )


def parse_duration(text: Column) -> Column:
    """Seconds of a ``PT#H#M#S`` duration; NULL when the text has another form."""
    form = "^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?\\z"

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, form, group).try_cast("long"), F.lit(0))

    return F.when(text.rlike(form), part(1) * 3600 + part(2) * 60 + part(3))
