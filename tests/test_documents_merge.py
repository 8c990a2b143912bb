"""Documents merged by path against a recursive merge in plain Python."""

import json
import random

from pyspark.sql import functions as F

from lintlake.operators.documents import deep_merge


def merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merged(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) if k not in b else b[k] for k in a.keys() | b.keys()}
    return b


def some(rng, depth=0):
    if depth < 4 and rng.random() < 0.65:
        return {rng.choice(["a", "b", 'c"x', "d.e", ""]): some(rng, depth + 1) for _ in range(rng.randrange(4))}
    return rng.choice([1, 2.5, "x", "", None, True, [], [1, {"a": 2}], "l\nq\"", {}, {"z": {}}])


def test_random_documents(spark):
    rng = random.Random(6)
    docs = [[some(rng) for _ in range(rng.randrange(1, 5))] for _ in range(1_000)]
    rows = [(i, n, json.dumps(d)) for i, layers in enumerate(docs) for n, d in enumerate(layers)]
    rng.shuffle(rows)
    got = deep_merge(spark.createDataFrame(rows, "doc int, layer int, j string").select("doc", "layer", F.parse_json("j").alias("body"))).collect()
    assert len(got) == len(docs)
    for r in got:
        want = docs[r["doc"]][0]
        for over in docs[r["doc"]][1:]:
            want = merged(want, over)
        assert json.loads(r["merged"]) == want, docs[r["doc"]]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc int, layer int, j string").select("doc", "layer", F.parse_json("j").alias("body"))
    assert deep_merge(empty).collect() == []


def test_no_side_is_sent_to_all(spark, monkeypatch):
    """The driver holds no side of a join, however small the written tables look."""
    from pyspark.sql import functions as F

    from lintlake.operators import documents as d

    plans = []
    monkeypatch.setattr(d, "written", lambda df, n, w=d.written: (w(df, n), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    layers = spark.range(50).select(F.col("id").alias("doc"), F.lit(0).alias("layer"), F.parse_json(F.lit('{"a": {"b": 1}, "c": {}}')).alias("body"))
    assert d.deep_merge(layers).count() == 50
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
