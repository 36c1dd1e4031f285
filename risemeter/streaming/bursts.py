"""Vote bursts: more than ``limit`` events of a key within a window that opens with an event.

The window of a key opens with its first event, stays for a fixed time and is replaced by the
next event after that. It is not aligned to the clock, so it needs the key's events in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from risemeter.streaming.tables import keyed_state, prepare, run_available, store, stored

# Events allowed per window and its length.
LIMIT = 5
WINDOW_SECONDS = 60

EVENT = "key STRING, event_id BIGINT, at BIGINT"
FLAGGED = f"{EVENT}, flagged BOOLEAN"
_OPEN = "start BIGINT, used INT"


def _mark(at: np.ndarray, start: int | None, used: int, limit: int, length: int) -> tuple[np.ndarray, int, int]:
    """Flags for one key's sorted event times, continuing an open window."""
    flagged = np.zeros(len(at), dtype=bool)
    i = 0
    while i < len(at):
        if start is None or at[i] > start + length:
            start, used = int(at[i]), 0
        j = int(np.searchsorted(at, start + length, side="right"))
        flagged[i + max(0, limit - used) : j] = True
        used = min(limit, used + j - i)
        i = j
    return flagged, start, used


def segments(events: DataFrame, length: int) -> DataFrame:
    """(key, bin, segment): runs of a key's occupied time bins of one window's length.

    Behind an empty bin a gap is longer than the window, so a new window opens with the next event, whatever came before:
    segments of a key do not depend on one another. There is one row per key and bin here, not per event.
    """
    bins = events.select("key", F.floor(F.col("at") / length).cast("long").alias("bin")).distinct()
    order = Window.partitionBy("key").orderBy("bin")
    cut = bins.withColumn("_cut", F.coalesce(F.col("bin") - F.lag("bin").over(order) > 1, F.lit(True)).cast("int"))
    return cut.select("key", "bin", F.sum("_cut").over(order).alias("segment"))


def flag_bursts(events: DataFrame, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Events (key, event_id, at in microseconds) with ``flagged``.

    Spark partitions by key and segment and sorts (with spill); each task passes over its sorted batches and
    remembers only the open window, so memory does not grow with a key's rows, and a key with very many
    events runs in as many tasks as it has segments.
    """
    length = int(window_seconds * 1_000_000)
    binned = events.select("key", "event_id", "at", F.floor(F.col("at") / length).cast("long").alias("bin"))
    ordered = binned.join(segments(events, length), ["key", "bin"]).repartition("key", "segment").sortWithinPartitions("key", "segment", "at", "event_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, used = None, None, 0
        for batch in batches:
            if batch.empty:
                continue
            keys, parts = batch["key"].to_numpy(), batch["segment"].to_numpy()
            bounds = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
            at, flags = batch["at"].to_numpy(), []
            for run in np.split(np.arange(len(batch)), bounds):
                if (keys[run[0]], parts[run[0]]) != last:
                    last, start, used = (keys[run[0]], parts[run[0]]), None, 0
                marks, start, used = _mark(at[run], start, used, limit, length)
                flags.append(marks)
            yield batch[["key", "event_id", "at"]].assign(flagged=np.concatenate(flags))

    return ordered.select("key", "segment", "event_id", "at").mapInPandas(scan, FLAGGED)


def ingest_bursts(
    stream: DataFrame, folder: str, limit: int = LIMIT, window_seconds: float = WINDOW_SECONDS
) -> DataFrame:
    """Flagged events of everything that has arrived.

    The open window of each key is keyed state: a batch touches the state of its own keys only. A task holds the
    times and ids of one key's events of one batch, to sort them.
    """
    spark, table, length = stream.sparkSession, f"{folder}/flags", int(window_seconds * 1_000_000)
    prepare(spark, table, FLAGGED)

    def mark(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        events = np.concatenate([chunk[["at", "event_id"]].to_numpy(dtype=np.int64) for chunk in chunks])
        events = events[np.lexsort((events[:, 1], events[:, 0]))]
        flags, start, used = _mark(events[:, 0], start, used, limit, length)
        state.update((start, used))
        yield pd.DataFrame({"key": key[0], "event_id": events[:, 1], "at": events[:, 0], "flagged": flags})

    with keyed_state(spark):
        flagged = stream.select("key", "event_id", "at").groupBy("key").applyInPandasWithState(mark, FLAGGED, _OPEN, "append", GroupStateTimeout.NoTimeout)
        run_available(flagged, lambda batch, n: store(batch, table, n), f"{folder}/checkpoint")
    return stored(spark, table, f"{FLAGGED}, batch_id INT").select("key", "event_id", "at", "flagged")
