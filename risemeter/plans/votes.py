"""Votes: validation, upserts, outcomes, tallies and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from risemeter.functions.misc import CATALOG_VOTE_TYPES, vote_outcome
from risemeter.operators.predicates import valid_votes
from risemeter.operators.tallies import duplicate_votes, vote_tally
from risemeter.sources.sinks import latest_votes


def accepted_votes(votes: DataFrame, targets: DataFrame, kinds: list[str] = CATALOG_VOTE_TYPES) -> DataFrame:
    """Valid votes on existing targets."""
    return valid_votes(votes, kinds).join(targets.select("target_id"), "target_id", "left_semi")


def vote_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The vote table with the last choice per (target, voter) of stored and incoming votes."""
    columns = ["target_id", "voter_id", "vote_type", "created_at", "vote_id"]
    return latest_votes(stored.select(*columns).unionByName(incoming.select(*columns)))


def vote_outcomes(votes: DataFrame, span: str = "hour") -> DataFrame:
    """Each vote with the outcome its sender saw.

    A vote follows from the one before it. Within a pair and a ``span`` of time that is a lag; the first vote of a span follows
    the last one of the pair's span before, of which there is one row each. So a pair with very many votes is spread over its spans.
    """
    pair, time = ["target_id", "voter_id"], F.struct("created_at", "vote_id")
    placed = votes.withColumn("_span", F.date_trunc(span, "created_at"))
    ends = placed.groupBy(*pair, "_span").agg(F.max_by("vote_type", time).alias("_end"))
    before = Window.partitionBy(*pair).orderBy("_span")
    carried = ends.select(*pair, "_span", F.lag("_end").over(before).alias("_carried"))
    inside = Window.partitionBy(*pair, "_span").orderBy("created_at", "vote_id")
    listed = placed.withColumn("_before", F.lag("vote_type").over(inside)).withColumn("_place", F.row_number().over(inside))
    joined = listed.join(carried, [*pair, "_span"])
    previous = F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return joined.withColumn("outcome", vote_outcome(previous, F.col("vote_type"))).select(*votes.columns, "outcome")


def vote_counts(votes: DataFrame, kinds: list[str] = CATALOG_VOTE_TYPES) -> DataFrame:
    return vote_tally(votes, kinds)


def vote_audit(votes: DataFrame) -> DataFrame:
    return duplicate_votes(votes).orderBy(F.desc("duplicate_count"), "target_id", "voter_id", "vote_id")
