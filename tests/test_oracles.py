"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables; the others run."""

import duckdb
import pytest

from lintlake.plans import registry
from lintlake.plans.base import RULES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in registry.ORACLE_SQL:
        cur = duck.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", ["t2_cascade", "j16_record_pairs"])
def test_cascade_on_every_remainder(spark, tmp_path, name):
    """What the cascade asks of a finding follows from its number modulo 4, 5 and 9: each rule meets all of these together."""
    line = " ".join(pattern for _, pattern, _, _ in RULES)
    docs = [(i, line, "en", "web") for i in range(180)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert len(want) == 180 * len(RULES)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want)


@pytest.mark.parametrize("name, n", [("t2_cascade", 201 * len(RULES)), ("j16_record_pairs", 200 * len(RULES)), ("a2_status_counts_filled", 4)])
def test_findings_on_odd_ids(spark, tmp_path, name, n):
    """Remainders of numbers below zero are not above zero; a finding of a document without an id has none either: it pairs with nothing and is not counted."""
    line = " ".join(pattern for _, pattern, _, _ in RULES)
    docs = [(i, line, "en", "web") for i in range(-180, 20)] + [(None, line, "en", "web"), (20, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert len(want) == n
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want)
