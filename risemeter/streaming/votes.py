"""Votes as a stream: last choice per (target, voter) with the outcome of each vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from risemeter.plans.votes import vote_outcomes
from risemeter.streaming.tables import prepare, run_available, store, stored

VOTE = "target_id BIGINT, voter_id STRING, vote_type STRING, created_at TIMESTAMP, vote_id BIGINT"
OUTCOME = f"{VOTE}, outcome STRING"
PAIR = ["target_id", "voter_id"]
# After so many batches the last votes are merged into one base.
MERGE_EVERY = 8


def running_choice(stream: DataFrame) -> DataFrame:
    """Last choice per (target, voter) as a streaming aggregation (update mode)."""
    return stream.groupBy(*PAIR).agg(F.max_by("vote_type", F.struct("created_at", "vote_id")).alias("vote_type"))


def _last(rows: DataFrame) -> DataFrame:
    others = ["vote_type", "created_at", "vote_id"]
    newest = rows.groupBy(*PAIR).agg(F.max_by(F.struct(*others), F.struct("created_at", "vote_id")).alias("_v"))
    return newest.select(*PAIR, "_v.*")


def state_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The last votes before a batch: the newest base, and what the batches since then changed.

    Which folders these are follows from the number of the batch, so a repeated batch reads what it read at first,
    and no batch reads more than one base and ``MERGE_EVERY`` - 1 changes, however many came before.
    """
    merged = batch_id // MERGE_EVERY * MERGE_EVERY - 1
    schema = f"{VOTE}, batch_id INT"
    base = stored(spark, f"{folder}/base", schema).where(F.col("batch_id") == merged)
    changes = stored(spark, f"{folder}/changes", schema).where((F.col("batch_id") > merged) & (F.col("batch_id") < batch_id))
    return base.unionByName(changes).drop("batch_id")


def ingest_votes(stream: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(current votes, outcomes) after all votes that have arrived.

    Stored choices of the voters in a batch come before the batch's own votes, so the outcome of
    each vote follows from the vote before it. Votes are taken in time order within a batch.
    """
    spark, state, outcomes = stream.sparkSession, f"{folder}/state", f"{folder}/outcomes"
    prepare(spark, f"{state}/base", VOTE)
    prepare(spark, f"{state}/changes", VOTE)
    prepare(spark, outcomes, OUTCOME)
    columns = [*PAIR, "vote_type", "created_at", "vote_id"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        session, votes = batch.sparkSession, batch.select(*columns)
        known = _last(state_before(session, state, batch_id).join(votes.select(*PAIR).distinct(), PAIR, "left_semi"))
        both = known.withColumn("_new", F.lit(False)).unionByName(votes.withColumn("_new", F.lit(True)))
        store(vote_outcomes(both).where("_new").drop("_new"), outcomes, batch_id)
        store(_last(both.drop("_new")), f"{state}/changes", batch_id)
        if (batch_id + 1) % MERGE_EVERY == 0:
            changed = stored(session, f"{state}/changes", f"{VOTE}, batch_id INT").where(F.col("batch_id") == batch_id).drop("batch_id")
            store(_last(state_before(session, state, batch_id).unionByName(changed)), f"{state}/base", batch_id)

    run_available(stream, handle, f"{folder}/checkpoint")
    rows = stored(spark, outcomes, f"{OUTCOME}, batch_id INT").drop("batch_id")
    return _last(rows.drop("outcome")), rows
