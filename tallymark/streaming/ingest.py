"""Requests of visitors, views and forms alike, on one stream: limited by visitor, validated, and every one given a verdict.

A request is judged when it arrives (`seq`, the order of arrival, which the source gives): it passes if fewer than the limit of its kind passed in the span before
its time. One that comes late counts at the time of the latest that passed, so a visitor's clock never goes back and no time that has left the state could matter. Requests that are limited leave no trace; those that pass the limit count even if they turn out invalid. State is one short list of times by visitor and
kind, dropped when the visitor has been idle; it survives restarts with the checkpoint. The sink is partitioned by verdict, so what is
accepted is appended exactly once and what is rejected stands beside it for reports.

Inside a batch `seq` decides; the batches themselves must come in its order, which the source owes. Spark's file source goes by the files' times in milliseconds and takes
equal ones in any order, so files that arrive together are to be read in one batch or given times apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymark.streaming.limiter import accept

#: By kind, how many requests pass within how many milliseconds; kinds of forms; the form of an address.
LIMITS = {"pageview": (60, 60_000), "contact": (5, 600_000)}
FORMS = ["contacto", "sumate", "opt-out"]
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"

OUT = "seq long, key string, kind string, ts long, path string, ref string, form string, email string, verdict string"


def visitor(forwarded: Column, real: Column) -> Column:
    """Whom a request comes from: the first address it was forwarded for, else the real one, else `unknown`."""
    said = F.when(F.coalesce(forwarded, F.lit("")) != "", F.trim(F.split(forwarded, ",")[0]))
    return F.coalesce(said, F.when(F.coalesce(real, F.lit("")) != "", F.trim(real)), F.lit("unknown"))


def cut(x: Column, longest: int = 500) -> Column:
    """Up to `longest` characters, trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.substring(x, 1, longest)), F.lit(""))


def requests(rows: DataFrame) -> DataFrame:
    """Raw rows (seq, forwarded, real, kind, ts, path, ref, form, email) as requests with their visitor and `valid`.

    A view needs a path from the root, a form one of the known kinds and an address; other kinds are no requests and are left out. A missing time is now.
    """
    path, email = cut(F.col("path")), cut(F.col("email"), 200)
    valid = F.when(F.col("kind") == "pageview", path.startswith("/")).otherwise(F.col("form").isin(FORMS) & email.rlike(EMAIL))
    out = rows.where(F.col("kind").isin(list(LIMITS)) & F.col("seq").isNotNull())
    return out.select("seq", visitor(F.col("forwarded"), F.col("real")).alias("key"), "kind", F.coalesce("ts", F.unix_millis(F.current_timestamp())).alias("ts"), path.alias("path"), cut(F.col("ref")).alias("ref"), "form", email.alias("email"), F.coalesce(valid, F.lit(False)).alias("valid"))


def judge(batch: pd.DataFrame, times: dict[str, list[int]]) -> pd.DataFrame:
    """Verdicts of one visitor's requests in order of arrival; `times` (by kind) is brought up to date."""
    verdicts = []
    for kind, ts, valid in zip(batch["kind"], batch["ts"], batch["valid"]):
        held = times.get(kind, [])
        ok, times[kind] = accept(held, max(int(ts), held[-1] if held else int(ts)), *LIMITS[kind])
        verdicts.append("limited" if not ok else "accepted" if valid else "invalid")
    return batch.drop(columns=["valid"]).assign(verdict=verdicts)


def verdicts_stream(stream: DataFrame, idle: int | None = 600_000) -> DataFrame:
    """Verdicts on a stream of `requests`; a visitor who stays idle for `idle` milliseconds is forgotten.

    Timeouts keep a query running batches, so one that is to end by itself (`availableNow`) takes None: nobody is forgotten.
    """
    kinds = list(LIMITS)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # A visitor's rows of one batch, sorted whole, since arrival may have been dealt over partitions.
        batch = pd.concat(list(frames)).sort_values("seq", kind="stable")
        held = dict(zip(kinds, map(list, state.get))) if state.exists else {}
        yield judge(batch, held)[[c.split()[0] for c in OUT.split(", ")]]
        state.update(tuple(held.get(k, []) for k in kinds))
        if idle is not None:
            state.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("key").applyInPandasWithState(step, OUT, ", ".join(f"{k} array<long>" for k in kinds), "append", timeout)


def verdicts(rows: DataFrame) -> DataFrame:
    """The same on a finished table of `requests`; a visitor's rows are read in a stream, so a visitor of any size needs the limits' numbers of memory."""
    names = [c.split()[0] for c in OUT.split(", ")]
    own = rows.repartition("key").sortWithinPartitions("key", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, {}
        for batch in batches:
            for key, part in batch.groupby("key", sort=False):
                if key != last:
                    last, times = key, {}
                yield judge(part, times)[names]

    return own.mapInPandas(run, OUT)


def write(stream: DataFrame, path: str, checkpoint: str, idle: int | None = 600_000, **trigger):
    """A query that appends each request once, as JSON lines in a folder by verdict."""
    writer = verdicts_stream(stream, idle).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("verdict").outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def rejects(verdicts: DataFrame) -> DataFrame:
    """kind, verdict, visitors, n of what was not accepted."""
    return verdicts.where("verdict <> 'accepted'").groupBy("kind", "verdict", "key").agg(F.count("*").alias("n")).groupBy("kind", "verdict").agg(F.count("*").alias("visitors"), F.sum("n").alias("n"))
