"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Every component c of a vector becomes the integer ``x = floor(scale * c) + shift``. The model is fitted on the
distinct x vectors (the fit list), so copies weigh once. Their number n and sums S are exact integers; the scatter
of ``x - S/n`` is summed per task and added up by position, so that one d x d matrix reaches the driver, whatever
the number of rows (d: the length of a vector). There

    V = L L^T           pivoted Cholesky, columns by falling remaining diagonal, stopped at the numerical rank
    L J = U diag(s)     J: plane rotations that make the columns of L orthogonal, no product matrix formed

so the squared column norms s^2 are V's eigenvalues and the normalised columns its eigenvectors. Rotating the
factor itself keeps small eigenvalues to a high relative accuracy. Rows are then projected in their own tasks.

Defined results: a row whose vector is null, or holds a null or non-finite entry, takes no part, nor does an
empty vector; of vectors of several lengths, those of the length that most rows have (ties: the longest) take
part; a null or repeated id keeps its rows; copies share their figures; |floor(scale * c)| saturates at 2^60; a
deviation that no long can hold is null, never wrapped; only components of a variance above rounding come out,
so one distinct vector, constant vectors or an empty table give no rows. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMIT = 1 << 60
HALF = 1 << 31
STEP = 2048  # rows of a numpy step


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows that take part and ``x`` (array<long>), beside nothing but the columns of ``df`` but the vector."""
    v = F.col(vector).cast("array<double>")
    whole = F.transform(v, lambda c: F.least(F.greatest(F.floor(F.lit(float(scale)) * c).cast("double"), F.lit(-float(LIMIT))),
                                             F.lit(float(LIMIT))).cast("long") + F.lit(shift))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rest = [c for c in df.columns if c != vector]
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.select(*rest, whole.alias("x")).limit(0)
    return rows.where(F.size(vector) == lengths["d"]).select(*rest, whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _summed(parts: DataFrame) -> dict[int, tuple[int, ...]]:
    """Sums by position of the partial rows (i, values...)."""
    names = parts.columns[1:]
    return {r["i"]: tuple(r[c] for c in names)
            for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()}


def exact_sums(fit_list: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension, as Python integers (halves of 31 bits are summed)."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                n += len(x)
                high += (x >> 31).sum(axis=0)
                low += (x & (HALF - 1)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(d + 1, dtype=np.int32), "high": np.append(high, n),
                                          "low": np.append(low, 0)})

    got = _summed(fit_list.select("x").mapInArrow(sums, "i int, high long, low long"))
    if not got:
        return 0, [0] * d
    return got[d][0], [got[i][0] * HALF + got[i][1] for i in range(d)]


def _centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off in integers, the rest (below 1) in doubles."""
    return (x - mean).astype(np.float64) - rest


def scatter(fit_list: DataFrame, d: int, mean: np.ndarray, rest: np.ndarray, map_to: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of z z^T, z = (x - S/n), or its image under ``map_to``; its first row holds the sums of z."""
    width = d if map_to is None else map_to.shape[1]
    size = (width + 1) * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                z = _centred(_matrix(b.column(0).slice(a, STEP)), mean, rest)
                z = z if map_to is None else z @ map_to
                total[0] += z.sum(axis=0)
                total[1:] += z.T @ z
        yield pa.RecordBatch.from_pydict({"i": np.arange(size, dtype=np.int32), "v": total.reshape(-1)})

    got = _summed(fit_list.select("x").mapInArrow(sums, "i int, v double"))
    return np.array([got[i][0] if got else 0.0 for i in range(size)]).reshape(width + 1, width)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L^T: one column per pivot (the largest remaining diagonal entry), lower triangular in pivot order;
    ends where only rounding is left, so L has as many columns as v has rank."""
    rest = np.diag(v).astype(np.float64).copy()
    floor = max(len(v), 1) * 16 * np.finfo(float).eps * rest.max(initial=0.0)
    columns: list[np.ndarray] = []
    done = np.zeros(len(v), bool)
    while not done.all():
        p = int(np.argmax(np.where(done, -np.inf, rest)))
        if not rest[p] > floor:
            break
        known = np.array(columns).T if columns else np.zeros((len(v), 0))
        column = v[:, p] - known @ known[p]
        root = np.sqrt(rest[p])
        column = np.where(done, 0.0, column / root)
        column[p] = root
        done[p] = True
        rest = np.where(done, 0.0, rest - column * column)
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((len(v), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of factor factor^T, by plane rotations of the columns.

    A sweep meets all pairs in rounds of disjoint pairs, each round one vectorised step."""
    a = factor.copy()
    m = a.shape[1]
    order = np.arange(m + m % 2)
    tol = np.finfo(float).eps * max(len(a), 1)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(order) - 1, 0)):
            p, q = order[:len(order) // 2], order[len(order) // 2:][::-1]
            real = (p < m) & (q < m)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            on = np.abs(gamma) > tol * np.sqrt(alpha * beta)
            if on.any():
                turned = True
                zeta = (beta[on] - alpha[on]) / (2 * gamma[on])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                x, y = x[:, on], y[:, on]
                a[:, p[on]], a[:, q[on]] = c * x - s * y, s * x + c * y
            order = np.r_[order[:1], np.roll(order[1:], 1)]
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    by = by[norms[by] > 0]
    return norms[by] ** 2, a[:, by] / norms[by]


@dataclass(frozen=True)
class Whitening:
    """n and the exact sums of the fit list, its covariance's trace, eigenvalues and eigenvectors (columns)."""
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        return _mean(self.n, self.sums)


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // max(n, 1) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / max(n, 1) for s, w in zip(sums, whole)])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``rows`` (x: array<long> of one length), fitted on each distinct x once."""
    fit_list = materialize(rows.select("x").groupBy("x").agg(F.lit(0).alias("one")).select("x"), "whitening-fit")
    first = fit_list.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    n, sums = exact_sums(fit_list, d)
    whole, rest = _mean(n, sums)
    v = scatter(fit_list, d, whole, rest)[1:] / max(n, 1)
    values, vectors = one_sided_jacobi(pivoted_cholesky(v))
    values, vectors = values[:components], vectors[:, :components]
    if not len(values):
        return Whitening(n, sums, float(np.trace(v)), values, vectors, 0.0)
    both = scatter(fit_list, d, whole, rest, vectors / np.sqrt(values)) / n
    error = float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(len(values))).max())
    return Whitening(n, sums, float(np.trace(v)), values, vectors, error)


def _deviations(x: np.ndarray, n: int, sums: list[int], whole: np.ndarray) -> list[int | None] | np.ndarray:
    """Exact sums over the dimensions of (n x - S)^2; None where a long cannot hold one."""
    off = x - whole
    left = np.array([s - n * w for s, w in zip(sums, whole.tolist())], object)  # 0 <= left < n
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if most * most * x.shape[1] < 1 << 63:
        t = off * n - left.astype(np.int64)
        return (t * t).sum(axis=1)
    exact = ((off.astype(object) * n - left) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` with ``x`` replaced by ``deviation`` (long) and ``whitened`` (array<double>, one entry per component)."""
    keep = [c for c in rows.columns if c != "x"]
    whole, rest = model.mean
    to = model.vectors / np.sqrt(model.values)
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, whole, rest, to))

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def both(x: pa.Array) -> pa.Array:
        n, sums, mean, part, map_to = shared.value
        m = _matrix(x) if len(x) else np.zeros((0, len(mean)), np.int64)
        w = _centred(m, mean, part) @ map_to
        return pa.StructArray.from_arrays(
            [pa.array(_deviations(m, n, sums, mean) if len(m) else [], pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * map_to.shape[1]), pa.array(w.reshape(-1)))],
            names=["deviation", "whitened"])

    return rows.select(*keep, both("x").alias("x")).select(*keep, "x.deviation", "x.whitened")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row of ``df`` that takes part and component: key, component, n, deviation, whitened, explained,
    identity_error."""
    rows = integer_vectors(df.select(F.col(key).alias("row"), F.col(vector).alias("vector")), "vector")
    model = fit(rows, components)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    long = project(rows, model).select("row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(F.col("row").alias(key), (F.col("at") + 1).cast("int").alias("component"),
                       F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
