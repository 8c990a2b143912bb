"""Progress streams: job states, counts, and results with a time to live.

The same expressions serve batch tables and streams, so a stream over the same rows ends with the batch's result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an event makes of its job.
STATE = {"view": "queued", "signup": "running", "click": "running", "purchase": "completed", "error": "failed"}


def job_state(event: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in STATE.items() for x in p])[event]


def job_states(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Latest state of each job, and its events and failures so far. Streams keep one small row for each job (update or complete mode)."""
    last = F.max_by(job_state(F.col("event_type")), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("state"), F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


def progress(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and kind; on a stream, windows close when the watermark passes them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n")


def once_within(results: DataFrame, key: list[str], ttl: str) -> DataFrame:
    """Results of a stream, each key once within the time to live; state is dropped with the watermark."""
    return results.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def fresh(results: DataFrame, now: Column, days: int) -> DataFrame:
    """Cached results that are not expired."""
    return results.filter(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted run has still to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_progress(events: DataFrame, path: str, checkpoint: str):
    """Appends progress rows as JSON lines, exactly once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
