"""Jobs folded from their events: a state machine with illegal transitions told apart, repeats dropped, old jobs evicted.

Batch and stream give the same. The batch folds each job's events in order of time within one row. The stream keeps a
job's events until the watermark has passed them, so that late ones come in their place, and folds them then; an event
that comes again while it waits is one, later the watermark drops it. A job whose last step is older than the retention
is evicted by a timer, with all its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lintlake.streaming.jobs import job_state

# The states that may follow each state ("" stands for a job that is not there).
NEXT = {"": ("queued",), "queued": ("running", "failed"), "running": ("running", "completed", "failed"), "completed": (), "failed": ()}
RETENTION_MS = 2 * 24 * 3600 * 1000
FOLD = "state string, last long, n_steps long, n_illegal long"
OUT = f"job long, {FOLD}, event string"


def _legal(now: Column, new: Column) -> Column:
    """Whether `new` may follow `now`."""
    return F.array_contains(F.element_at(F.create_map(*[x for s, after in NEXT.items() for x in (F.lit(s), F.array(*[F.lit(a) for a in after]).cast("array<string>"))]), now), new)


def fold_jobs(events: DataFrame, retention_ms: int = RETENTION_MS, key: str = "user_id", until_ms: int | None = None) -> DataFrame:
    """job, state, last (time of the last step in ms), n_steps, n_illegal of each job after all its events; the state of a job that is not there is empty.

    An event that comes again counts once. A step that may not follow the state is counted and changes nothing. Where more
    than the retention lies between a step and the next event (or until_ms), the job was evicted: its counts are gone, and
    it may start anew. Illegal steps of a job that is not there are not kept.
    """
    step = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), job_state(F.col("event_type")).alias("to"))
    rows = events.groupBy(key).agg(F.array_sort(F.collect_set(step)).alias("_s"))
    start = F.struct(F.lit("").alias("state"), F.lit(None).cast("long").alias("last"), *[F.lit(0).cast("long").alias(n) for n in ("n_steps", "n_illegal")])

    def fold(acc: Column, x: Column) -> Column:
        gone = F.coalesce(x["at"] - acc["last"] > retention_ms, F.lit(False))
        now = F.when(gone, "").otherwise(acc["state"])
        ok = F.coalesce(_legal(now, x["to"]), F.lit(False))
        count = lambda n, on: F.when(gone, F.lit(0)).otherwise(acc[n]) + F.when(on, 1).otherwise(0)
        last = F.when(ok, x["at"]).when(~gone, acc["last"])
        return F.struct(F.when(ok, x["to"]).otherwise(now).alias("state"), last.alias("last"), count("n_steps", ok).alias("n_steps"), count("n_illegal", ~ok & (now != "")).alias("n_illegal"))

    out = rows.select(F.col(key).alias("job"), F.aggregate("_s", start, fold).alias("_r"))
    gone = F.lit(until_ms).cast("long") - F.col("_r.last") > retention_ms
    return out.withColumn("_r", F.when(gone, start).otherwise(F.col("_r"))).select("job", "_r.*")


class JobFold(StatefulProcessor):
    """A job's fold, its events that wait for the watermark, and a timer for what comes next."""

    def __init__(self, retention_ms: int):
        self.retention = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)
        self.waiting = handle.getMapState("waiting", "id long", "at long, to string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for i, at, to in zip(part["event_id"].tolist(), part["at"].tolist(), part["to"].tolist(), strict=True):
                if at > passed and not self.waiting.containsKey((i,)):
                    self.waiting.updateValue((i,), (at, to))
                    self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((v[0], k[0], v[1]) for k, v in self.waiting.iterator() if v[0] <= passed)
        held = tuple(self.fold.get()) if self.fold.exists() else ("", None, 0, 0)
        out = []
        for at, i, to in due:
            self.waiting.removeKey((i,))
            state, last, steps, illegal = held
            if last is not None and at - last > self.retention:
                out.append((key[0], *held, "evicted"))
                state, last, steps, illegal = "", None, 0, 0
            ok = to in NEXT[state]
            held = (to if ok else state, at if ok else last, steps + ok, illegal + (not ok and state != ""))
            out.append((key[0], *held, "step" if ok else "illegal"))
            if ok:
                self.handle.registerTimer(at + self.retention + 1)
        if held[1] is not None and passed - held[1] > self.retention:
            out.append((key[0], *held, "evicted"))
            held = ("", None, 0, 0)
        if not held[0]:
            self.fold.clear()
        elif due:
            self.fold.update(held)
        if out:
            table = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            table["last"] = table["last"].astype("Int64")
            yield table

    def close(self) -> None:
        pass


def stream_jobs(events: DataFrame, late: str = "1 day", retention_ms: int = RETENTION_MS, key: str = "user_id") -> DataFrame:
    """The fold of a stream of events, a row (OUT) for each step, illegal step and eviction once the watermark has passed it; the last row of a job is its fold. Needs the RocksDB state store."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(F.col(key).cast("long").alias("job"), "ts", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), job_state(F.col("event_type")).alias("to"))
    return rows.groupBy("job").transformWithStateInPandas(JobFold(retention_ms), OUT, "Update", "EventTime")
