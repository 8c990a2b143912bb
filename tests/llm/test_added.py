"""Fill-in-middle, whitening and decontamination against SQL, numpy and brute force, and on odd tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from lintlake.llm import decontaminate, fill_middle, queries, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, _state string, _words long, item string, row string, n long, part long, r string"


def table(spark, rows, n=3):
    return spark.createDataFrame([(i, t, "en", "s", 1, "i", "r", 2, 3, "x") for i, t in rows], DOCS).repartition(n)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_decontamination"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    assert [c[0] for c in cur.description] == df.columns
    want = sorted(cur.fetchall(), key=str)
    assert got(df) == want and len(want) > 100


# --- 11 fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(doc, text, rate=50, spm=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def strange(rng, n):
    return "".join(rng.choice("ab <>PSM\t\n\v\f\r\x00\x85\xa0ñ日😀é　") for _ in range(n))


def test_fill_middle_whole_results(spark):
    rng = random.Random(5)
    rows = [(i, strange(rng, rng.choice([1, 2, 7, 63, 64, 65, 300]))) for i in range(400)] + [(None, "a b c"), (None, None), (401, ""), (402, " \n"), (403, "x<M>y z"), (404, "<"), (405, "wort " * 300_000), (406, "x" * 900_000), (-7, "a  b "), (-7, "a  b ")]
    assert got(fill_middle.transform(table(spark, rows))) == sorted((middle(i, t) for i, t in rows), key=str)
    assert got(fill_middle.transform(table(spark, rows), rate=100, spm_rate=50, seed=7)) == sorted((middle(i, t, 100, 50, 7) for i, t in rows), key=str)
    for r in fill_middle.fill_middle(table(spark, rows), rate=100, spm_rate=50).collect():
        assert r["restored_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i == r["doc_id"]}


def test_fill_middle_empty_table(spark):
    assert fill_middle.fill_middle(table(spark, [])).collect() == []


def test_restore_takes_the_first_marks():
    for p in ("a<", "<S", "<P", ""):
        for m in ("S>", "<M", ""):
            for s in ("M>", "<", ""):
                assert fill_middle.restore(f"<P>{p}<S>{s}<M>{m}".encode(), "psm").decode() == p + m + s == fill_middle.restore(f"<S>{s}<P>{p}<M>{m}".encode(), "spm").decode()


@pytest.mark.parametrize("share", [0, 0.01, 0.5, 1])
def test_rank_and_select(share):
    flags = np.random.default_rng(3).random(3_001) < share
    bits = fill_middle.Bits(flags)
    assert (bits.rank(np.arange(3_002)) == np.r_[0, np.cumsum(flags)]).all()
    assert (bits.select(np.arange(1, flags.sum() + 1)) == np.flatnonzero(flags)).all()
    assert fill_middle.Bits(np.zeros(0, bool)).rank(np.array([0])).tolist() == [0]


# --- 12 whitening


def want_whitened(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors])
    n, s = len(x), [int(c) for c in x.sum(axis=0)]
    centred = np.array([[float(n * int(a) - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], centred @ v / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def vectors(spark, rows, n=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string, at int, part long").repartition(n)


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r["component"], []).append(r)
    return out


def test_whitening_whole_table(spark):
    data = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pylist()
    n, deviation, y, share = want_whitened([r["embedding"] for r in data])
    at = {r["vec_id"]: i for i, r in enumerate(data)}
    rows = queries.op12_whitening(spark, SF).collect()
    assert len(rows) == 8 * n and all(r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]] == int(r["deviation_exact"]) for r in rows)
    for k, part in by_component(rows).items():
        sign = np.sign(sum(r["whitened"] * y[at[r["vec_id"]], k - 1] for r in part))
        assert max(abs(r["whitened"] - sign * y[at[r["vec_id"]], k - 1]) for r in part) < 1e-7
        assert abs(part[0]["explained"] / share[k - 1] - 1) < 1e-9 and part[0]["identity_error"] < 1e-9
        assert len({(r["explained"], r["identity_error"]) for r in part}) == 1


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (41, [0.0, 0.0, 0.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 0.0]), (55, [1.0]), (56, [1.0, 2.0]), (57, [1e300, 0.0, 0.0])]
    rows = whitening.whiten(vectors(spark, [(i, v, "v", 1, 2) for i, v in good + bad])).collect()
    n, deviation, _, share = want_whitened([v for _, v in good])
    assert n == len(good) and sorted((str(r["vec_id"]), r["deviation"]) for r in rows) == sorted((str(i), d) for (i, _), d in zip(good, deviation, strict=True) for _ in range(3))
    assert np.allclose(sorted({r["explained"] for r in rows}, reverse=True), share) and max(r["identity_error"] for r in rows) < 1e-9


def test_whitening_without_variance(spark):
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], "v", 1, 2)])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 1.0], "v", 1, 2) for i in range(9)])).collect()
    parts = by_component(flat)
    assert all(r["whitened"] is None for r in parts[2]) and abs(parts[1][0]["explained"] - 1) < 1e-12 and parts[1][0]["identity_error"] < 1e-12
    assert whitening.whiten(vectors(spark, [])).collect() == [] == whitening.whiten(vectors(spark, [(1, None, "v", 1, 2)])).collect()


def test_whitening_stacks_by_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    data = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(300)]
    model = whitening.fit(vectors(spark, [(i, v, "v", 1, 2) for i, v in data], 9), "embedding")
    x = np.floor(1024 * np.array([v for _, v in data]))
    assert np.allclose(model.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], rtol=1e-12)


def test_jacobi_small_values_are_accurate():
    rng = np.random.default_rng(6)
    for d in (1, 2, 3, 8, 33):
        q = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2)]
        true = 10.0 ** -np.linspace(0, 6, d)
        s, v = whitening.jacobi(np.linalg.qr(q[0] * true @ q[1].T, mode="r"))
        assert np.allclose(s, true, rtol=1e-9) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_deviations_beyond_longs():
    n = 10**12 + 7
    x = np.array([[100_000, 99_000], [1 << 60, 5]], np.int64)
    sums = [n * 100_300 + 5, n * 99_000 - 3]
    centre = whitening.Centre(n, sums)
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert centre.deviations(x) == want and centre.deviations(x[:1]) == want[:1]


# --- 13 decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs, tests, window=10):
    names = {}
    for i, t in tests:
        w = WORD.findall(lower(t))
        k = min(window, len(w))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            names.setdefault(tuple(w[s : s + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, items = WORD.findall(lower(t)), set(), set()
        for k in {len(x) for x in names}:
            for s in range(len(w) - k + 1):
                if (found := names.get(tuple(w[s : s + k]))) is not None:
                    hit.update(range(s, s + k)), items.update(found)
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "e", "w", 3) for i, t in rows], "item_id long, text string, item string, words string, doc_id long")


def made(rng, n, of=5):
    return " ".join(rng.choice(("alpha", "Beta", "ça", "d9", "日本", "eps", "zeta")[:of]) + rng.choice(("", ",", ".", "'")) for _ in range(n))


@pytest.mark.parametrize("window, shard, block", [(10, None, None), (3, 64, 300), (1, 7, None), (4, 16, 200)])
def test_decontamination_whole_results(spark, monkeypatch, window, shard, block):
    if shard:
        monkeypatch.setattr(decontaminate, "SHARD", shard)
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(8)
    tests = [(i, made(rng, rng.choice([0, 1, 2, 4, 9, 10, 11, 30]), 5 if i % 2 else 7)) for i in range(25 if window > 1 else 3)]
    tests += [(2, made(rng, 12)), (None, made(rng, 15)), (100, None), (101, ""), (102, "?!"), (103, tests[-1][1])]
    docs = [(i, made(rng, rng.choice([0, 1, 5, 40, 400]))) for i in range(60)] + [(None, None), (None, tests[1][1]), (7, "x " + (tests[7 % len(tests)][1] or "") + " y"), (7, "x")]
    docs += [(i, "and " + made(random.Random(1), 200)) for i in range(200, 230)]
    rows = decontaminate.decontamination(table(spark, docs), items(spark, tests), window)
    assert got(rows) == contaminated(docs, tests, window)


def test_decontamination_many_copies_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TOGETHER", 1 << 16)
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(40))
    tests = [(i, passage) for i in range(300)] + [(300, "only here " * 8)]
    docs = [(i, f"start {i} {passage} end") for i in range(2_000)] + [(5_000, ("la " * 400_000) + passage), (5_001, "Only here " * 30_000), (5_002, "z" * 300_000)]
    assert got(decontaminate.decontamination(table(spark, docs), items(spark, tests))) == contaminated(docs, tests)


def test_decontamination_without_rows(spark):
    assert decontaminate.decontamination(table(spark, []), items(spark, [(1, "a b")])).collect() == []
    assert got(decontaminate.decontamination(table(spark, [(1, "a b"), (2, None)]), items(spark, []))) == contaminated([(1, "a b"), (2, None)], [])


def test_clean_keeps_whole_rows(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = table(spark, [(1, f"x {passage} y"), (2, "one two three"), (3, None), (4, passage.upper())])
    kept = decontaminate.clean(docs, items(spark, [(1, passage)]))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and {r["item"] for r in kept.collect()} == {"i"}


@pytest.mark.parametrize("block", [None, 300])
def test_longest_matches(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(10)
    tests = [(i, made(rng, rng.choice([1, 5, 20, 60]), 7)) for i in range(12)] + [(50, "nowhere"), (51, None)]
    docs = [(i, made(rng, 80, 7)) for i in range(20)] + [(20, "omega " + tests[5][1] + " omega")]
    found = {r["item_id"]: r for r in decontaminate.longest_matches(table(spark, docs), items(spark, tests)).collect()}
    split = {i: WORD.findall(lower(t)) for i, t in docs}
    for i, t in tests:
        w = WORD.findall(lower(t))
        best = max((k for k in range(1, len(w) + 1) if any(d[x : x + k] == w[s : s + k] for s in range(len(w) - k + 1) for d in split.values() for x in range(len(d)))), default=0)
        if not best:
            assert str(i) not in found
            continue
        r = found[str(i)]
        assert r["n_words"] == best and split[r["doc_id"]][r["doc_word"] : r["doc_word"] + best] == w[r["item_word"] : r["item_word"] + best]


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(12)
    ids = rng.integers(0, 4, 3_000)
    array = decontaminate.SuffixArray(ids, 3, 40)
    cut = [tuple(ids[p : p + 40].tolist()) for p in array.at]
    cut = [x[: x.index(0)] if 0 in x else x for x in cut]
    assert sorted(array.at.tolist()) == np.flatnonzero(ids).tolist() and cut == sorted(cut)


def test_words_of_slices():
    texts = pa.array(["skip", "Ab-c9", None, "", "ñÑ x"])[1:]
    found, counts = decontaminate.words(texts)
    assert [w.decode() for w in found.to_pylist()] == ["ab", "c9", "ñÑ", "x"] and counts.tolist() == [2, 0, 0, 2]
