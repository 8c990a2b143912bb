"""Embedding whitening by a one-sided Jacobi SVD of what blockwise TSQR leaves of the centred rows.

Entries become whole numbers, so sums and deviations are exact. Each task turns its centred rows into one triangular
matrix, batch after batch; the matrices of FAN tasks at a time are stacked and turned again, level by level, until FAN or
fewer are left: dims x dims numbers each, however many rows there are. Plane rotations then make the columns of the last
one orthogonal: their norms are the singular values, accurate also for the small ones, as no covariance is formed, and the
accumulated rotations are the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import pick, ready, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Triangular matrices that one task stacks.
FAN = 16
#: Entries at or beyond this cannot be told apart as longs after centring; their rows are dropped like non-finite ones.
LIMIT = 1 << 61
#: Columns count as orthogonal below this cosine; singular values below this share of the largest count as zero.
COSINE, ZERO = 1e-15, 1e-13
SWEEPS = 60
LONG = 1 << 63


def numbers(column: pa.Array, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch without null or non-finite entries, as whole numbers, by length (only `dim`, if given): rows and numbers."""
    column = column.cast(pa.list_(pa.float64()))
    if not len(column):
        return {}
    cuts = column.offsets.to_numpy().astype(np.int64)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(cuts), 0)
    values = column.values
    flat = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist() if dim is None else [dim]:
        rows = np.flatnonzero(sizes == d)
        c = flat[cuts[rows][:, None] + np.arange(d)] if len(rows) else np.empty((0, d))
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(SCALE * c)
            good = (np.abs(scaled) < LIMIT).all(axis=1)  # false for what is not finite
        if good.any() or dim is not None:
            out[d] = rows[good], scaled[good].astype(np.int64) + SHIFT
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for b in batches:
        for d, (rows, x) in numbers(b.column(0)).items():
            held = total.setdefault(d, [0, np.zeros(d, object)])
            held[0] += len(rows)
            # halves, so that no sum of a batch leaves a long
            held[1] = held[1] + ((x >> 31).sum(axis=0).astype(object) << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
    cols = [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([[Decimal(v) for v in s] for _, s in total.values()], pa.list_(pa.decimal128(38, 0)))]
    yield pa.record_batch(cols, names=["dim", "n", "total"])


class Centre:
    """Row count and exact sums; what centres a batch."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = [s - (s // n) * n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2 = (n*u - r)^2 with u = x - S // n and r = S mod n, exact."""
        u, n = x - self.base, self.n
        most = int(np.abs(u).max(initial=0)) + 1
        if self.dim * most * max(most, 1 << 24) < LONG and n < 1 << 48:
            low = np.array([r & 0xFFFFFF for r in self.rest], np.int64)
            high = np.array([r >> 24 for r in self.rest], np.int64)
            square, cross = (u * u).sum(axis=1).astype(object), (u @ low).astype(object) + ((u @ high).astype(object) << 24)
            return (square * (n * n) - cross * (2 * n) + sum(r * r for r in self.rest)).tolist()
        return ((u.astype(object) * n - np.array(self.rest, object)) ** 2).sum(axis=1).tolist()


def _triangle(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def _factor(centre: Centre):
    """One triangular matrix for each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, part = np.empty((0, centre.dim)), TaskContext.get().partitionId()
        for b in batches:
            _, x = numbers(b.column(0), centre.dim).get(centre.dim, (None, np.empty((0, centre.dim), np.int64)))
            if len(x):
                r = _triangle(np.vstack([r, centre.centred(x)]))
        if len(r):
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

    return run


def _stack(dim: int):
    """The matrices of each group as one; rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, r = None, np.empty((0, dim))

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([group], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

        for b in batches:
            for g, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if group is not None and g != group:
                    yield out()
                    r = np.empty((0, dim))
                group, r = g, _triangle(np.vstack([r, np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, dim)]))
        if group is not None:
            yield out()

    return run


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (as columns) of r, by plane rotations of its columns; disjoint pairs of columns are turned together."""
    dim = r.shape[1]
    even = dim + dim % 2
    a, v = np.zeros((max(r.shape[0], 1), even)), np.eye(even)
    a[: r.shape[0], :dim] = r
    ring = np.arange(even)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = (size > 0) & (np.abs(gamma) > COSINE * size)
            if turn.any():
                worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
                p, q = p[turn], q[turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                for m in (a, v):
                    x, y = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            ring[1:] = np.roll(ring[1:], 1)
        if worst <= 1000 * COSINE:  # what a sweep leaves is the square of what it met
            break
    sigma = np.linalg.norm(a, axis=0)
    order = np.argsort(-sigma[:dim], kind="stable") if even == dim else np.array([i for i in np.argsort(-sigma, kind="stable") if i != dim])
    sigma, v = sigma[order], v[:dim, order]
    top = np.abs(v).argmax(axis=0)
    return sigma, v * np.where(v[top, np.arange(dim)] < 0, -1.0, 1.0)


class Whitener:
    """Components, their eigenvalues and shares; components without any variance give null."""

    def __init__(self, centre: Centre, r: np.ndarray, most: int = COMPONENTS) -> None:
        sigma, v = jacobi(r)
        self.centre, self.k = centre, min(most, centre.dim)
        value = sigma**2 / centre.n
        self.values, self.vectors = value[: self.k], v[:, : self.k]
        self.shares = self.values / value.sum() if value.sum() > 0 else np.full(self.k, np.nan)
        self.some = sigma[: self.k] > ZERO * max(sigma[0], 0.0)
        self.deviation = sigma[: self.k] / np.sqrt(centre.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = self.centre.centred(x) @ self.vectors
        y[:, self.some] /= self.deviation[self.some]
        y[:, ~self.some] = np.nan
        return y


def _products(model: Whitener):
    """Sums of products of whitened rows (their mean is zero, as rows are centred)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = 0.0, int(model.some.sum())
        for b in batches:
            got = numbers(b.column(0), model.centre.dim).get(model.centre.dim)
            if got is not None and len(got[1]):
                y = model.whitened(got[1])[:, model.some]
                total = total + y.T @ y
        if np.ndim(total):
            yield pa.record_batch([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    return run


def _rows(model: Whitener, error: float | None):
    k, n = model.k, model.centre.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = numbers(b.column(1), model.centre.dim).get(model.centre.dim)
            if got is None or not len(got[0]):
                continue
            rows, x = got
            y, exact = model.whitened(x).ravel(), model.centre.deviations(x)
            each = np.repeat(np.arange(len(rows)), k)
            deviation = pa.array([v if v < LONG else None for v in exact], pa.int64()).take(pa.array(each))
            whole = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(pa.array(each))
            share = np.tile(model.shares, len(rows))
            cols = [b.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1), len(rows)).astype(np.int32)), pa.array(np.full(len(each), n)), deviation, whole]
            cols += [pa.array(y, mask=np.isnan(y)), pa.array(share, mask=np.isnan(share)), pa.array([error] * len(each), pa.float64())]
            yield pa.record_batch(cols, names=["vec_id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])

    return run


def fit(vectors: DataFrame, vec_col: str, most: int = COMPONENTS) -> Whitener | None:
    """The whitener of all vectors of the commonest length (of equals the longest) without null or non-finite entries; None without any."""
    only = pick(vectors, vec_col)
    parts = written(only.mapInArrow(_sums, "dim int, n long, total array<decimal(38,0)>"), "whitening-sums")
    usual = parts.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return None
    each = parts.filter(F.col("dim") == usual["dim"]).select(F.posexplode("total").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    centre = Centre(usual["n"], [int(r["v"]) for r in sorted(each, key=lambda r: r["at"])])
    left, matrices = only.rdd.getNumPartitions(), only.mapInArrow(_factor(centre), "part long, r binary")
    while left > FAN:
        left = -(-left // FAN)
        grouped = matrices.select((F.col("part") % left).alias("part"), "r").repartition(min(left, 4 * FAN * FAN), "part").sortWithinPartitions("part", "r")
        matrices = written(grouped.mapInArrow(_stack(centre.dim), "part long, r binary"), "whitening-r")
    last = [np.frombuffer(bytes(x["r"]), "<f8").reshape(-1, centre.dim) for x in sorted(matrices.collect(), key=lambda x: x["part"])]
    return Whitener(centre, _triangle(np.vstack(last)), most)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component up to `most`: vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error.

    Vectors that are null or empty, hold null or non-finite entries, or are of another than the commonest length (of
    equals the longest) are dropped, as are entries beyond 2^61 / 1024. Rows that repeat stay and count. Null ids stay
    null. deviation is null where it does not fit a long (deviation_exact holds it up to 38 digits). A component without variance has
    null in whitened and no part in identity_error, which is null without any other; explained is null if no component
    varies. An empty table gives none; other columns are ignored.
    """
    spark = ready(vectors.sparkSession)
    model = fit(vectors, vec_col, most)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double")
    k = int(model.some.sum())
    sums = pick(vectors, vec_col).mapInArrow(_products(model), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect() if k else []
    cov = np.zeros(k * k)
    for r in sums:
        cov[r["at"]] = r["v"] / model.centre.n
    error = float(np.abs(cov.reshape(k, k) - np.eye(k)).max()) if k else None
    rows = pick(vectors, id_col, vec_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"))
    return rows.mapInArrow(_rows(model, error), "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double")
