"""A sliding-window rate limiter per key: at most `most` accepted events in the last `span_ms`; rejected events leave no trace."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accept(times: list[int], ts: int, most: int, span_ms: int) -> tuple[bool, list[int]]:
    """Whether an event at `ts` passes, and the accepted times that still count."""
    live = [t for t in times if t > ts - span_ms]
    return (True, [*live, ts]) if len(live) < most else (False, live)


def limit_batch(events: DataFrame, most: int = 60, span_ms: int = 60_000) -> DataFrame:
    """key, ts, event_id, accepted of a finished log.

    A partition's events come sorted by key and time and are read in a stream, so a key of any size needs `most` numbers of memory.
    """
    rows = events.select("key", "ts", "event_id").repartition("key").sortWithinPartitions("key", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for batch in batches:
            passed = []
            for k, ts in zip(batch["key"], batch["ts"]):
                if k != key:
                    key, times = k, []
                ok, times = accept(times, int(ts), most, span_ms)
                passed.append(ok)
            yield batch.assign(accepted=passed)

    return rows.mapInPandas(run, "key string, ts long, event_id long, accepted boolean")


def limit_stream(events: DataFrame, most: int = 60, span_ms: int = 60_000) -> DataFrame:
    """The same on a stream; a key that stays idle for `span_ms` is forgotten."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for batch in frames:
            batch = batch.sort_values(["ts", "event_id"])
            passed = []
            for ts in batch["ts"]:
                ok, times = accept(times, int(ts), most, span_ms)
                passed.append(ok)
            yield batch[["key", "ts", "event_id"]].assign(accepted=passed)
        state.update((times,))
        state.setTimeoutDuration(span_ms)

    return events.groupBy("key").applyInPandasWithState(step, "key string, ts long, event_id long, accepted boolean", "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
