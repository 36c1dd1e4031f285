"""Review of ambiguous matches: candidates, judgments, decisions and manual overrides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from risemeter.functions.judgments import REASON_LENGTH, answer_error, judgment_key, judgment_status, parse_judgments
from risemeter.functions.numbers import round_half_up
from risemeter.operators.links import first_by, without
from risemeter.operators.predicates import EXCLUDED_METHOD, MANUAL_METHODS
from risemeter.session import spread
from risemeter.sources.sinks import mention_rows, rebuilt_mentions

# Candidates per run, and confidence of links made by judgment or by hand.
CANDIDATES_PER_RUN = 50
JUDGED_CONFIDENCE = 90
MANUAL_CONFIDENCE = 100


def review_candidates(
    pairs: DataFrame, items: DataFrame, judged: DataFrame, limit: int | None = None
) -> DataFrame:
    """Ambiguous (item, catalog) pairs not judged yet, each once.

    With a ``limit``, such as ``CANDIDATES_PER_RUN``, only the first ones by id: one review run.
    """
    keyed = pairs.select("item_id", "catalog_id").distinct().withColumn(
        "judgment_key", judgment_key(F.col("item_id"), F.col("catalog_id"))
    )
    waiting = without(keyed, judged, "judgment_key").join(items.select("item_id", "entity_id", "title"), "item_id")
    return waiting if limit is None else waiting.orderBy("item_id", "catalog_id").limit(limit)


@dataclass
class AppliedJudgments:
    judgments: DataFrame
    error_judgments: DataFrame
    accepted: DataFrame
    confirmed: DataFrame
    new_links: DataFrame
    matched_items: DataFrame
    summary: DataFrame
    items: DataFrame

    @property
    def mentions(self) -> DataFrame:
        """Mentions to insert or update: every confirmed pair, linked before or not, with the item's counters."""
        return mention_rows(self.confirmed, self.items)


def apply_judgments(candidates: DataFrame, responses: DataFrame, items: DataFrame, links: DataFrame) -> AppliedJudgments:
    """Route parsed responses and link what is confirmed.

    ``candidates`` (batch_id, candidate_index, item_id, catalog_id) were sent in batches,
    ``responses`` (batch_id, response_text) came back. A link needs an automatic status, the
    candidate's own catalog id, an item without manual status and no existing link of the pair.

    A batch that came back without a JSON array (or NULL, with the message in an optional column
    ``error``) gives an error judgment of confidence 0 per candidate, so that the pairs do not wait
    again. Batches without a response row were not answered, such as those behind an exhausted quota,
    and candidates that a readable answer passes over get no judgment; both are only counted.
    """
    # The whole answer would travel with each of its elements, as the struct of a grouped minimum is not pruned.
    answered = parse_judgments(responses).drop("response_text")
    parsed = first_by(answered, ["batch_id", "candidate_index"], F.struct("element"))
    # Spark estimates exploded variants at a small part of their size, and would gather all answers in the driver to broadcast them.
    joined = candidates.join(parsed.hint("merge"), ["batch_id", "candidate_index"], "left")
    judged = joined.where(F.col("confidence").isNotNull()).select(
        "batch_id", "candidate_index", "item_id", "catalog_id", "judged_catalog_id",
        judgment_key(F.col("item_id"), F.col("catalog_id")).alias("judgment_key"),
        judgment_status(F.col("confidence")).alias("status"),
        round_half_up(F.col("confidence") * 100).alias("confidence"),
        "reason", "matched_terms",
    )
    message = answer_error(F.col("response_text"))
    if "error" in responses.columns:
        message = F.when(message.isNotNull(), F.coalesce("error", message))
    failed = responses.groupBy("batch_id").agg(
        F.min(F.substring(message, 1, REASON_LENGTH)).alias("reason"), F.max(message.isNull()).alias("_read")
    )
    errors = candidates.join(failed.where(~F.col("_read")).drop("_read"), "batch_id").select(
        "batch_id", "candidate_index", "item_id", "catalog_id", F.lit(None).cast("long").alias("judged_catalog_id"),
        judgment_key(F.col("item_id"), F.col("catalog_id")).alias("judgment_key"),
        F.lit("error").alias("status"), F.lit(0).cast(judged.schema["confidence"].dataType).alias("confidence"),
        "reason", F.array().cast("array<string>").alias("matched_terms"),
    )
    accepted = judged.where(
        (F.col("status") == "auto_linked") & F.col("judged_catalog_id").eqNullSafe(F.col("catalog_id"))
    )
    open_items = items.where(~F.col("match_status").isin(MANUAL_METHODS)).select("item_id")
    confirmed = accepted.select("item_id", "catalog_id").distinct().join(open_items, "item_id", "left_semi")
    new_links = without(confirmed, links, ["item_id", "catalog_id"]).select(
        "item_id", "catalog_id", F.lit("alias").alias("method"), F.lit(JUDGED_CONFIDENCE).alias("confidence")
    )
    agreed = F.col("judged_catalog_id").eqNullSafe(F.col("catalog_id"))
    status = judgment_status(F.col("confidence"))
    has = F.col("confidence").isNotNull()
    summary = joined.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(has & (status == "auto_linked") & agreed).alias("auto_linked"),
        F.count_if(has & (status == "pending")).alias("pending"),
        F.count_if(has & ((status == "rejected") | ((status == "auto_linked") & ~agreed))).alias("rejected"),
        F.count_if(~has).alias("failed"),
    )
    matched = confirmed.select("item_id").distinct()
    return AppliedJudgments(judged, errors, accepted, confirmed, new_links, matched, summary, items)


@dataclass
class AppliedReviews:
    judgments: DataFrame
    new_links: DataFrame
    mentions: DataFrame
    matched_items: DataFrame


def apply_reviews(judgments: DataFrame, decisions: DataFrame, links: DataFrame, items: DataFrame) -> AppliedReviews:
    """Approve (link, mention, item matched, judgment auto_linked) or reject judgments.

    ``decisions`` is (judgment_id, decision). Approving needs a catalog and an entity id. A mention
    names the entity of the pair's first judgment and has the item's counters, 0 for an unknown item.
    """
    joined = judgments.join(decisions, "judgment_id", "left")
    complete = F.col("catalog_id").isNotNull() & F.col("entity_id").isNotNull()
    approved = (F.col("decision") == "approve") & complete
    status = F.when(approved, "auto_linked").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    chosen = joined.where(approved).groupBy("item_id", "catalog_id").agg(
        F.max("confidence").alias("confidence"), F.min(F.struct("judgment_id", "entity_id"))["entity_id"].alias("entity_id")
    )
    new_links = without(chosen, links, ["item_id", "catalog_id"]).select(
        "item_id", "catalog_id", F.lit("alias").alias("method"), "confidence"
    )
    counters = ["view_count", "like_count", "comment_count"]
    known = items.select("item_id", "title", *counters, "published_at")
    mentions = chosen.drop("confidence").join(known, "item_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counters}
    )
    updated = joined.withColumn("status", status).select(*judgments.columns)
    return AppliedReviews(updated, new_links, mentions, chosen.select("item_id").distinct())


@dataclass
class AppliedOverrides:
    links: DataFrame
    items: DataFrame
    touched: DataFrame

    @property
    def mentions(self) -> DataFrame:
        """All mentions of the touched items; they replace those stored for these items."""
        return rebuilt_mentions(spread(self.links, "item_id").join(self.touched, "item_id", "left_semi"), self.items)


def apply_overrides(items: DataFrame, links: DataFrame, catalog: DataFrame, overrides: DataFrame) -> AppliedOverrides:
    """Manual links and exclusions (item_id, catalog_id, kind link/exclude, position).

    The last override of a pair replaces its link. Items touched become manual while any active
    link is left, else manual_excluded. Overrides of unknown items or entries are ignored.
    """
    valid = overrides.join(items.select("item_id"), "item_id", "left_semi").join(
        catalog.select("catalog_id"), "catalog_id", "left_semi"
    )
    last = valid.groupBy("item_id", "catalog_id").agg(F.max_by("kind", "position").alias("kind"))
    is_link = F.col("kind") == "link"
    made = last.select(
        "item_id",
        "catalog_id",
        F.when(is_link, "manual").otherwise(EXCLUDED_METHOD).alias("method"),
        F.when(is_link, F.lit(MANUAL_CONFIDENCE)).otherwise(F.lit(0)).alias("confidence"),
    )
    stored = spread(links.select("item_id", "catalog_id", "method", "confidence"), "item_id", "catalog_id")
    kept = without(stored, last, ["item_id", "catalog_id"])
    new_links = kept.unionByName(made)
    touched = last.select("item_id").distinct()
    states = (
        spread(new_links, "item_id").join(touched, "item_id", "left_semi")
        .groupBy("item_id")
        .agg(F.max(F.col("method") != EXCLUDED_METHOD).alias("_active"))
    )
    joined = items.join(states, "item_id", "left")
    status = (
        F.when(F.col("_active").isNull(), F.col("match_status")).when(F.col("_active"), "manual").otherwise("manual_excluded")
    )
    return AppliedOverrides(new_links, joined.withColumn("match_status", status).drop("_active"), touched)
