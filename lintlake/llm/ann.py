"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Lists: k-means centres fitted on a bounded sample; every vector is put into the list of its nearest centre. Equal vectors
are one class (its smallest ids are kept, as many as a result can hold), so copies cost nothing. A query visits the lists
whose centres are nearest; how many is calibrated on the sample for a recall target. Scan: unit vectors are turned by one
random rotation and cut into column blocks; after each block a candidate whose scaled partial distance fails the test
against the query's k-th best distance so far is abandoned. Those that reach the last block are scored exactly, in double
precision, on the original vectors.

Long lists are cut into cells of at most about CELL vectors, so neither a list nor a cluster of copies grows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import join_hot, pick, ready, tasks, written

#: Bounds of the fitting sample (at least LEAST, then EACH for every list) and of the number of lists.
LEAST, SAMPLE, EACH, LISTS = 20_000, 65_536, 4, 16_384
ROUNDS = 8
BLOCK = 16
#: The test's strictness: a candidate is abandoned when its estimate exceeds the k-th distance by this many deviations.
EPSILON = 2.1
RECALL = 0.985
CELL = 4_096
QUERIES = 256
#: Pairs that are scored at once.
PAIRS = 1 << 15
#: Products of vectors and centres that are held at once.
SCORES = 1 << 22


def vectors(column) -> np.ndarray:
    """A column of packed double vectors as rows."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def near(u: np.ndarray, c: np.ndarray, most: int = 1) -> np.ndarray:
    """Of each unit vector its `most` nearest centres, nearest first; products are made SCORES at a time."""
    out, step = np.empty((len(u), most), np.int64), max(1, SCORES // len(c))
    for i in range(0, len(u), step):
        s = u[i : i + step] @ c.T
        out[i : i + step] = s.argmax(axis=1)[:, None] if most == 1 else np.argsort(-s, axis=1, kind="stable")[:, :most]
    return out


def centres(u: np.ndarray, k: int, seed: int = 13) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = u[rng.choice(len(u), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = near(u, c)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, u)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def probes(u: np.ndarray, c: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Lists to visit so that, in the sample, `recall` of the true neighbours of some of its vectors lie in them."""
    q = u[:: max(1, len(u) // QUERIES)][:QUERIES]
    s = q @ u.T
    s[s > 1 - 1e-9] = -2  # themselves and their copies
    k = min(k, len(u) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    home = near(u, c)[:, 0]
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(rank, home[best], axis=1), recall)) + 1


def scan(q: np.ndarray, x: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of x (with their ids) for each of q within one cell: (query, candidate, score), both given as original vectors. Of equal scores the smaller ids."""
    qu, xu = unit(q), unit(x)
    qr, xr = (qu @ turn).astype(np.float32), (xu @ turn).astype(np.float32)
    nq, nx, dim = len(q), len(x), q.shape[1]
    k = min(k, nx)
    # the first candidates are measured in full: they give each query its first k-th distance
    lead = min(nx, max(4 * k, 64))
    full = 2 - 2 * (qr @ xr[:lead].T)
    limit = np.partition(full, k - 1, axis=1)[:, k - 1]
    part = np.zeros((nq, nx), np.float32)
    alive = np.ones((nq, nx), bool)
    rows, cols = np.empty(0, np.int64), np.empty(0, np.int64)
    sparse, d = None, 0
    for at in range(0, dim, BLOCK):
        a, b = qr[:, at : at + BLOCK], xr[:, at : at + BLOCK]
        d = min(dim, at + BLOCK)
        if sparse is None:
            part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            alive = part * (dim / d) <= (limit * (1 + EPSILON / np.sqrt(d)) ** 2)[:, None] + 1e-5 if d < dim else part <= limit[:, None] + 1e-5
            if alive.sum() < 0.2 * alive.size:
                rows, cols = np.nonzero(alive)
                sparse = part[rows, cols]
        else:
            diff = a[rows] - b[cols]
            sparse = sparse + (diff * diff).sum(axis=1)
            keep = sparse * (dim / d) <= limit[rows] * (1 + EPSILON / np.sqrt(d)) ** 2 + 1e-5 if d < dim else sparse <= limit[rows] + 1e-5
            rows, cols, sparse = rows[keep], cols[keep], sparse[keep]
    if sparse is None:
        rows, cols = np.nonzero(alive)
    score = np.empty(len(rows))
    long_q, long_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    for at in range(0, len(rows), PAIRS):  # equal vectors can keep every pair alive
        r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
        score[at : at + PAIRS] = np.einsum("ij,ij->i", q[r], x[c]) / (long_q[r] * long_x[c])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], cols[nth < k], score[nth < k]


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or v is None or len(v) != dim or any(x is None for x in v):
                    continue
                a = np.array(v, "<f8")
                if np.isfinite(a).all() and a.any():
                    ids.append(i), out.append((a + 0.0).tobytes())  # +0: no negative zeros
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "vec"])

    return run


def _assign(sent, most: int):
    """To each vector its `most` nearest lists, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            at = near(unit(vectors(b.column(1))), c, most)
            flat = pa.array(at.ravel().astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)), flat)
            yield pa.record_batch([b.column(0), b.column(1), lists], names=["id", "vec", "lists"])

    return run


def _search(turn: np.ndarray, k: int):
    """Rows come sorted by cell, a cell's vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, vecs = None, [], []
        x = None

        def answer(qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            known = np.array(ids, np.int64)
            r, c, s = scan(q, x, known, turn, k)
            return pa.record_batch([pa.array(qid[r]), pa.array(known[c]), pa.array(s)], names=["query", "found", "score"])

        for b in batches:
            cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(cells)]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if cells[s] != cell:
                    cell, ids, vecs, x = cells[s], [], [], None
                if kinds[s] == 0:
                    ids += b.column(2).slice(s, e - s).to_pylist()
                    vecs += b.column(3).slice(s, e - s).to_pylist()
                elif vecs:
                    if x is None:
                        x = vectors(pa.array(vecs, pa.binary()))
                    for i in range(s, e, QUERIES):
                        n = min(QUERIES, e - i)
                        yield answer(b.column(2).slice(i, n).to_numpy(), vectors(b.column(3).slice(i, n)))

    return run


def nearest(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The k nearest rows of each query (a row whose id is divisible by `every`): query_id, rank, vec_id, score.

    Vectors that are null, zero, of another than the commonest length, or hold null or non-finite components take no
    part, nor do rows without id. Rows that repeat an id are one row (the vector smallest in byte order). A query's own
    row is no candidate; a query without any candidate gives no row. Ties go to the smaller id. An empty table gives
    none; other columns are ignored.
    """
    spark = ready(table.sparkSession)
    raw = pick(table, id_col, vec_col)
    usual = raw.groupBy(F.size(vec_col).alias("d")).count().filter("d > 0").orderBy(F.desc("count"), "d").first()
    dim = usual["d"] if usual else 1
    rows = written(raw.mapInArrow(_pack(dim), "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec")), "ann-rows")
    # classes of equal vectors: the smallest k + 1 ids of each, limited before the shuffle
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("_n", nth).filter(F.col("_n") <= k + 1)
    classes = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids"), "ann-classes")
    n = classes.count()
    queries = rows.filter(F.col("id") % every == 0)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(LISTS, int(n**0.5)))
    rows_wanted = min(SAMPLE, max(LEAST, EACH * lists))
    by_hash = F.pmod(F.xxhash64("vec"), F.lit(1 << 40))
    likely = classes.select("vec", by_hash.alias("h")).filter(F.col("h") < int((1 << 40) * min(1.0, (1.1 * rows_wanted + 100) / n)))
    got = likely.orderBy("h", "vec").limit(rows_wanted).collect()  # the same rows in whatever order they lie
    sample = unit(vectors(pa.array([bytes(r["vec"]) for r in got], pa.binary())))
    centre = centres(sample, min(lists, len(sample)))
    visit = min(len(centre), probes(sample, centre, k, recall))
    sent, turn = spark.sparkContext.broadcast(centre), rotation(dim)
    placed = written(classes.select("id", "vec").mapInArrow(_assign(sent, 1), "id long, vec binary, lists array<int>").select("id", "vec", F.col("lists")[0].alias("list")), "ann-lists")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))  # at most LISTS rows
    cell = lambda chunk: F.col("list").cast("long") * (1 << 31) + chunk
    index = placed.join(F.broadcast(sizes), "list").select(cell(F.pmod(F.xxhash64("id"), F.col("cells"))).alias("cell"), F.lit(0).alias("kind"), "id", "vec")
    asked = classes.join(queries.groupBy("vec").agg(F.count("*").alias("n")), "vec").select("id", "vec", "n")
    asked = written(asked, "ann-queries")
    routed = asked.select("id", "vec").mapInArrow(_assign(sent, visit), "id long, vec binary, lists array<int>").select("id", "vec", F.explode("lists").alias("list"))
    routed = routed.join(F.broadcast(sizes), "list").select(F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("c"), "list", "id", "vec").select(cell(F.col("c")).alias("cell"), F.lit(1).alias("kind"), "id", "vec")
    both = index.unionByName(routed).repartition(tasks(spark, table), "cell").sortWithinPartitions("cell", "kind")
    hits = both.mapInArrow(_search(turn, k + 1), "query long, found long, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    hits = hits.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k + 1).drop("_n")
    named = hits.join(classes.select(F.col("id").alias("found"), "ids"), "found").select("query", "score", F.explode("ids").alias("vec_id"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1)
    top = asked.join(named.groupBy("query").agg(best.alias("top")), asked["id"] == F.col("query")).select("vec", "n", "top")
    top = written(top, "ann-top")
    return _expand(queries, top, k)


def _expand(queries: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """Each query gets its class's list without itself; classes with many queries are joined apart."""
    total = top.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keyed = top.select(F.hex("vec").alias("key"), "n", "top")
    left = queries.select(F.col("id").alias("query_id"), F.hex("vec").alias("key"))
    out = join_hot(left, keyed, "key", F.col("n"), total, F.col("query_id").cast("string"))
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
