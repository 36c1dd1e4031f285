"""Queries for the streaming jobs, run over the events file with everything available."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.dates import local_day
from risemeter.queries.registry import query, text
from risemeter.session import fresh_folder
from risemeter.streaming import bursts, snapshots, votes
from risemeter.streaming.tables import run_available, store
from risemeter.views import Views


def event_stream(v: Views) -> DataFrame:
    return (
        v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    )


def _snapshot_stream(v: Views) -> DataFrame:
    return event_stream(v).select(
        F.col("user_id").alias("entity_id"),
        local_day(F.col("ts")).alias("date"),
        F.floor("value").cast("long").alias("subscriber_count"),
        F.col("ts").cast("timestamp").alias("collected_at"),
        "event_id",
    )


@query(
    "st1_first_snapshots",
    """SELECT entity_id, CAST(date AS VARCHAR) AS date, event_id, subscriber_count FROM observations
    QUALIFY row_number() OVER (PARTITION BY entity_id, date ORDER BY collected_at, event_id) = 1""",
)
def _(v: Views) -> DataFrame:
    folder = fresh_folder(v.spark, "snapshots")
    rows = snapshots.ingest_first_snapshots(_snapshot_stream(v), folder, "entity_id", F.struct("collected_at", "event_id"))
    return rows.select("entity_id", *text("date"), "event_id", "subscriber_count")


@query("st1_first_within_watermark", "SELECT DISTINCT entity_id, CAST(date AS VARCHAR) AS date FROM observations")
def _(v: Views) -> DataFrame:
    folder = fresh_folder(v.spark, "watermark")
    first = snapshots.first_within_watermark(_snapshot_stream(v), "entity_id", "collected_at", "2 days")
    run_available(first, lambda batch, n: store(batch, f"{folder}/rows", n), f"{folder}/checkpoint")
    return v.spark.read.parquet(f"{folder}/rows").select("entity_id", *text("date"))


def _vote_stream(v: Views) -> DataFrame:
    return event_stream(v).selectExpr(
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS target_id", "concat('voter-', user_id) AS voter_id",
        "CASE event_type WHEN 'purchase' THEN 'want_to_play' WHEN 'signup' THEN 'want_to_play' WHEN 'view' THEN 'wait_and_see' "
        "WHEN 'error' THEN 'not_interested' ELSE 'maybe' END AS vote_type",
        "CAST(ts AS TIMESTAMP) AS created_at", "event_id AS vote_id",
    )


@query(
    "st2_current_votes",
    "SELECT target_id, voter_id, arg_max(vote_type, row(created_at, vote_id)) AS vote_type FROM votes GROUP BY ALL",
)
def _(v: Views) -> DataFrame:
    current, _ = votes.ingest_votes(_vote_stream(v), fresh_folder(v.spark, "votes"))
    return current.select("target_id", "voter_id", "vote_type")


@query(
    "st2_vote_outcomes",
    """SELECT vote_id, CASE WHEN prior IS NULL THEN 'recorded' WHEN prior = vote_type THEN 'already_recorded' ELSE 'updated' END
    AS outcome FROM (SELECT *, lag(vote_type) OVER (PARTITION BY target_id, voter_id ORDER BY created_at, vote_id) AS prior FROM votes)""",
)
def _(v: Views) -> DataFrame:
    _, outcomes = votes.ingest_votes(_vote_stream(v), fresh_folder(v.spark, "votes"))
    return outcomes.select("vote_id", "outcome")


@query(
    "st2_running_choice",
    "SELECT target_id, voter_id, arg_max(vote_type, row(created_at, vote_id)) AS vote_type FROM votes GROUP BY ALL",
)
def _(v: Views) -> DataFrame:
    folder = fresh_folder(v.spark, "choice")
    stream = (
        votes.running_choice(_vote_stream(v)).writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: store(batch, f"{folder}/rows", n))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    # A pair is written again whenever it changes: its row of the latest batch counts.
    changes = v.spark.read.parquet(f"{folder}/rows")
    return changes.groupBy("target_id", "voter_id").agg(F.max_by("vote_type", "batch_id").alias("vote_type"))


_WINDOW = 24 * 3600
# Windows follow one another per key: each opens with the first event after the last one closed.
_BURSTS_SQL = f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) AS t,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT key, n, event_id, t AS opened, 1 AS used FROM e WHERE n = 1
        UNION ALL SELECT e.key, e.n, e.event_id, CASE WHEN e.t > w.opened + {_WINDOW}000000 THEN e.t ELSE w.opened END,
        CASE WHEN e.t > w.opened + {_WINDOW}000000 THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
    SELECT key, event_id, used > 5 AS flagged FROM w"""


@query("st3_vote_bursts", _BURSTS_SQL)
def _(v: Views) -> DataFrame:
    stream = event_stream(v).selectExpr(
        "CAST(user_id AS STRING) AS key", "event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS at"
    )
    rows = bursts.ingest_bursts(stream, fresh_folder(v.spark, "bursts"), window_seconds=_WINDOW)
    return rows.select("key", "event_id", "flagged")


@query("st3_batch_bursts", _BURSTS_SQL)
def _(v: Views) -> DataFrame:
    events = v.table("events").selectExpr(
        "CAST(user_id AS STRING) AS key", "event_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS at"
    )
    return bursts.flag_bursts(events, window_seconds=_WINDOW).select("key", "event_id", "flagged")
