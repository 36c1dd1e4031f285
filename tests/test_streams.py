"""Streams over several files, so that state carries over between batches."""

import datetime as dt

from pyspark.sql import functions as F

from risemeter.streaming import bursts, snapshots, votes


def stream(spark, folder, schema, batches):
    """A stream that reads one file per batch; each call of the job sees what was written so far."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_first_snapshot_stays(spark, rows, folder):
    schema = "entity_id BIGINT, date DATE, subscriber_count BIGINT, collected_at TIMESTAMP"
    day = dt.date(2026, 7, 1)
    at = lambda h: dt.datetime(2026, 7, 1, h)
    order = F.struct("collected_at")
    first = stream(spark, folder, schema, [[(1, day, 10, at(1)), (1, day, 11, at(2))]])
    got = snapshots.ingest_first_snapshots(first, folder, "entity_id", order)
    assert rows(got, "entity_id", "subscriber_count") == [(1, 10)]
    later = stream(spark, folder, schema, [[(1, day, 5, at(0)), (2, day, 7, at(3))], [(1, dt.date(2026, 7, 2), 12, at(9)), (2, day, 8, at(4))]])
    got = snapshots.ingest_first_snapshots(later, folder, "entity_id", order)
    assert rows(got, "entity_id", "subscriber_count") == [(1, 10), (1, 12), (2, 7)]


def test_votes_over_batches(spark, rows, folder):
    at = lambda m: dt.datetime(2026, 7, 1, 1, m)
    schema = votes.VOTE
    current, outcomes = votes.ingest_votes(stream(spark, folder, schema, [[(1, "voter-001", "want_to_play", at(1), 1)]]), folder)
    assert rows(outcomes, "vote_id", "outcome") == [(1, "recorded")]
    batches = [
        [(1, "voter-001", "want_to_play", at(2), 2), (1, "voter-002", "wait_and_see", at(2), 3)],
        [(1, "voter-001", "not_interested", at(3), 4)],
    ]
    current, outcomes = votes.ingest_votes(stream(spark, folder, schema, batches), folder)
    assert rows(current, "voter_id", "vote_type") == [("voter-001", "not_interested"), ("voter-002", "wait_and_see")]
    got = rows(outcomes, "vote_id", "outcome")
    assert [o for v, o in got if v in (1, 3)] == ["recorded", "recorded"]
    # The order of the two later files is the stream's; the pair's outcomes follow it.
    assert sorted(o for v, o in got if v in (2, 4)) in (["already_recorded", "updated"], ["updated", "updated"])


def direct(events, limit, length):
    """The limiter stated over sorted events."""
    state, flagged = {}, set()
    for key, event_id, at in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        start, used = state.get(key, (None, 0))
        if start is None or start + length < at:
            state[key] = (at, 1)
        elif used >= limit:
            flagged.add(event_id)
        else:
            state[key] = (start, used + 1)
    return flagged


def test_bursts(spark, folder):
    import random

    random.seed(3)
    second = 1_000_000
    events, clock = [], 0
    for i in range(3000):
        clock += random.choice([0, 1, 2, 30]) * second
        events.append(("hot" if random.random() < 0.4 else f"k{random.randint(0, 20)}", i, clock))
    expected = direct(events, 5, 60 * second)
    frame = spark.createDataFrame(events, bursts.EVENT)
    got = {r.event_id for r in bursts.flag_bursts(frame).where("flagged").collect()}
    assert got == expected and expected
    # The same in three batches: open windows carry over.
    for part in (events[:1000], events[1000:2000], events[2000:]):
        flags = bursts.ingest_bursts(stream(spark, folder, bursts.EVENT, [part]), folder)
    rows = flags.collect()
    assert len(rows) == 3000
    assert {r.event_id for r in rows if r.flagged} == expected


def test_burst_limit_is_exclusive(spark):
    events = [("k", i, i * 1_000_000) for i in range(7)] + [("k", 7, 60_000_000), ("k", 8, 60_000_001)]
    frame = spark.createDataFrame(events, bursts.EVENT)
    got = sorted(r.event_id for r in bursts.flag_bursts(frame).where("flagged").collect())
    # Five pass; the window still holds at exactly 60 seconds and is replaced just after.
    assert got == [5, 6, 7]


def test_a_hot_key_runs_in_several_tasks(spark):
    second = 1_000_000
    events = [("hot", i, (i // 8) * 300 * second + i % 8) for i in range(400)]
    frame = spark.createDataFrame(events, bursts.EVENT)
    marked = bursts.flag_bursts(frame)
    assert {r.event_id for r in marked.where("flagged").collect()} == direct(events, 5, 60 * second)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert bursts.flag_bursts(frame).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert bursts.segments(frame, 60 * second).select("segment").distinct().count() == 50


def test_a_batch_of_votes_reads_one_base_and_a_few_changes(spark, folder):
    at = dt.datetime(2026, 7, 1)
    batches = [[(1, f"voter-{k:04d}", "ab"[b % 2], at + dt.timedelta(hours=b), 100 * b + k) for k in range(5)] for b in range(20)]
    current, outcomes = votes.ingest_votes(stream(spark, folder, votes.VOTE, batches), folder)
    assert current.count() == 5 and outcomes.count() == 100
    assert outcomes.where("outcome = 'recorded'").count() == 5
    # Five pairs: a base of five rows and up to seven changes of five rows, at batch 3 as at batch 19.
    assert [votes.state_before(spark, f"{folder}/state", n).count() for n in (0, 3, 8, 9, 16, 19)] == [0, 15, 5, 10, 5, 20]


def test_a_batch_of_one_day_reads_one_day(spark, folder):
    schema = "entity_id BIGINT, date DATE, subscriber_count BIGINT, collected_at TIMESTAMP"
    days = [dt.date(2026, 7, d) for d in range(1, 6)]
    rows = [[(1, day, 10, dt.datetime(2026, 7, day.day))] for day in days]
    got = snapshots.ingest_first_snapshots(stream(spark, folder, schema, rows), folder, "entity_id", F.struct("collected_at"))
    assert got.count() == 5
    one = spark.read.parquet(f"{folder}/snapshots").where(F.col("date") == F.lit(days[0]))
    assert len(one.inputFiles()) >= 5 and one.select(F.input_file_name()).distinct().count() == 1


def test_outcomes_of_a_pair_with_most_votes(spark):
    import itertools
    import random

    dice = random.Random(8)
    start = dt.datetime(2026, 7, 1)
    rows = [(1, "hot", dice.choice("abc"), start + dt.timedelta(minutes=dice.randint(0, 3000)), i) for i in range(300)]
    rows += [(dice.randint(1, 3), f"v{dice.randint(0, 9)}", dice.choice("ab"), start + dt.timedelta(minutes=dice.randint(0, 3000)), 1000 + i) for i in range(200)]
    wanted = {}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4])), key=lambda r: r[:2]):
        before = None
        for r in group:
            wanted[r[4]] = "recorded" if before is None else "already_recorded" if before == r[2] else "updated"
            before = r[2]
    from risemeter.plans.votes import vote_outcomes

    found = vote_outcomes(spark.createDataFrame(rows, votes.VOTE))
    assert {r.vote_id: r.outcome for r in found.collect()} == wanted
