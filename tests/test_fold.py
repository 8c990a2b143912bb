"""Streams of job events end with the batch's fold; old jobs are evicted."""

import random

import pytest

from lintlake.streaming import fold

DAY = 24 * 3600 * 1000
START = 1_700_000_000_000
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def rows_of(events):
    import datetime

    return [(i, datetime.datetime.fromtimestamp(t / 1000, datetime.UTC).replace(tzinfo=None), u, e) for i, t, u, e in events]


def by_hand(events, retention, until=None):
    out = {}
    for i, t, u, e in sorted(set(events), key=lambda x: (x[1], x[0])):
        to = {"view": "queued", "signup": "running", "click": "running", "purchase": "completed", "error": "failed"}.get(e)
        state, last, steps, illegal = out.get(u, ("", None, 0, 0))
        if last is not None and t - last > retention:
            state, last, steps, illegal = "", None, 0, 0
        ok = to in fold.NEXT[state]
        out[u] = (to if ok else state, t if ok else last, steps + ok, illegal + (not ok and state != ""))
    return {u: ("", None, 0, 0) if until is not None and r[1] is not None and until - r[1] > retention else r for u, r in out.items()}


def made(rng, n=240, days=12, users=5):
    return [(i, START + rng.randrange(days * DAY), rng.randrange(users), rng.choice(["view", "view", "signup", "click", "click", "purchase", "error"])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_batch_fold(spark, seed):
    rng = random.Random(seed)
    events = made(rng)
    events += rng.sample(events, 20) + [(1_000, START, 77, "click"), (1_001, START, 78, "odd"), (1_002, START, None, "view")]
    df = spark.createDataFrame(rows_of(events), SCHEMA).repartition(4)
    for until in (None, START + 13 * DAY):
        assert {r["job"]: tuple(r)[1:] for r in fold.fold_jobs(df, DAY, until_ms=until).collect()} == by_hand(events, DAY, until)


def test_stream_ends_with_the_batch(spark, tmp_path):
    rng = random.Random(7)
    events = sorted(made(rng, 150, 8), key=lambda e: e[1] + rng.randrange(DAY // 2))  # late by half a day at most
    files = [events[i : i + 30] for i in range(0, len(events), 30)]
    for i, part in enumerate(files):
        part = part + rng.sample(part, 5) + (files[0][:3] if i == 4 else [])  # again at once, and again when long past
        spark.createDataFrame(rows_of(part), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
    last = max(e[1] for e in events)
    spark.createDataFrame(rows_of([(9_999, last + DAY + 1, -1, "view")]), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "99"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = fold.stream_jobs(source, "1 day", DAY).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got, told = {}, {"step": 0, "illegal": 0, "evicted": 0}
    for r in spark.table("folded").collect():  # a job's rows are in order
        told[r["event"]] += 1
        got[r["job"]] = ("", None, 0, 0) if r["event"] == "evicted" else (r["state"], r["last"], r["n_steps"], r["n_illegal"])
    want = by_hand(events, DAY, last)
    assert {u: got.get(u, ("", None, 0, 0)) for u in want} == want
    assert min(told.values()) > 5 and told["step"] + told["illegal"] == len(events)
