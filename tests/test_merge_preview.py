"""Counts of the merge preview, and how they grow with the duplicates of one entry."""

from collections import Counter

from risemeter.plans.merge import merge_preview

LINKS = "catalog_id BIGINT, item_id BIGINT, method STRING"
ITEMS = "item_id BIGINT, match_status STRING, content_type STRING"
VOTES = "target_id BIGINT, voter_id STRING"
JUDGMENTS = "catalog_id BIGINT, judgment_id BIGINT"


def preview(spark, links, votes, groups):
    items = spark.createDataFrame([(i, "matched", "short") for i in range(5)], ITEMS)
    linked = spark.createDataFrame([(c, i, "alias") for c, i in links], LINKS)
    voted = spark.createDataFrame(votes, VOTES)
    judged = spark.createDataFrame([(c, 1) for c, _ in links], JUDGMENTS)
    return merge_preview(linked, items, linked, voted, judged, spark.createDataFrame(groups, "canonical_id BIGINT, duplicate_id BIGINT"))


def counts(rows, canonical, duplicate, times):
    kept, moved = Counter(k for c, k in rows if c == canonical), Counter(k for c, k in rows if c == duplicate)
    return (
        times * (sum(kept.values()) + sum(moved.values())), len(kept | moved), times * sum(moved.values()),
        times * sum(n for k, n in moved.items() if k in kept),
    )


def test_counts_with_null_keys_repeated_rows_and_groups(spark):
    links = [(1, 1), (1, 2), (1, 2), (1, None), (2, 2), (2, None), (2, 3), (3, 4), (3, 4), (9, 1)]
    votes = [(1, "a"), (1, None), (2, None), (2, "a"), (2, "a"), (3, "b"), (7, "c")]
    groups = [(1, 2), (1, 3), (1, 3), (5, 6), (7, 8), (8, 7)]
    got = preview(spark, links, votes, groups).collect()
    assert sorted((r.canonical_id, r.duplicate_id) for r in got) == sorted(groups)
    for r in got:
        times = groups.count((r.canonical_id, r.duplicate_id))
        for name, rows in (("links", links), ("mentions", links), ("votes", votes)):
            found = tuple(r[f"{name}_{c}"] for c in ("before", "after", "to_move", "shared"))
            assert found == counts(rows, r.canonical_id, r.duplicate_id, times), (r, name)
        assert r.judgments_to_move == times * sum(c == r.duplicate_id for c, _ in links)
        assert r.rankable_after == len({i for c, i in links if c in (r.canonical_id, r.duplicate_id) and i is not None})


def largest_output(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return largest_output(plan.executedPlan())
    rows = plan.metrics().get("numOutputRows")
    most = rows.get().value() if rows.isDefined() else 0
    below = plan.plan() if "QueryStageExec" in plan.getClass().getSimpleName() else None
    children = [below] if below is not None else [plan.children().apply(k) for k in range(plan.children().size())]
    return max([most, *map(largest_output, children)])


def test_rows_do_not_multiply_with_the_duplicates(spark):
    """300 duplicates of an entry with 400 votes: no step makes rows times duplicates."""
    groups = [(1, 100 + k) for k in range(300)]
    done = preview(spark, [(1, 1)], [(1, f"v{k}") for k in range(400)], groups)
    rows = done.collect()
    assert len(rows) == 300 and all(r.votes_before == 400 and r.votes_to_move == 0 for r in rows)
    assert largest_output(done._jdf.queryExecution().executedPlan()) < 2_000
