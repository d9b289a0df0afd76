"""Whitening against numpy's eigenvalues and exact Python integers."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import whitening as W
from conftest import SF001
from lexiframe.session import read_table

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, components=16):
    """(n, {row index -> deviation}, eigenvalues, explained) of the valid vectors, from exact integers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    distinct = [list(t) for t in {tuple(r) for r in x}]
    n, d = len(distinct), len(distinct[0])
    s = [sum(r[j] for r in distinct) for j in range(d)]
    z = np.array([[n * r[j] - s[j] for j in range(d)] for r in distinct], float) / n
    e = np.linalg.eigvalsh(z.T @ z / n)[::-1]
    return n, [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x], e, e / e.sum(), x, s


def test_table_equals_numpy(spark):
    table = read_table(spark, SF001, "embeddings")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect()}
    n, deviations, e, share, x, s = brute(list(rows.values()))
    got = W.whiten(table).toPandas()
    assert set(got.n) == {n} and sorted(got.component.unique()) == list(range(1, 17)) and len(got) == 16 * len(rows)
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip(rows, deviations))
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, share[:16], rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(rows)].to_numpy()
    z = (np.array(x) - np.array(s) / n)
    back = np.linalg.lstsq(z, w * np.sqrt(e[:16]), rcond=None)[0]  # the components that were projected on
    assert np.allclose(back.T @ back, np.eye(16), atol=1e-8)
    _, first = np.unique(np.array(x), axis=0, return_index=True)
    cov = np.cov(w[first].T, bias=True)
    assert np.abs(cov - np.eye(16)).max() < 1e-8


def test_factor_reproduces_the_matrix_and_jacobi_its_spectrum():
    rng = np.random.default_rng(5)
    for rank, d in ((3, 7), (7, 7), (1, 4), (12, 30)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
        v = b @ b.T
        factor = W.pivoted_cholesky(v)
        assert factor.shape[1] <= rank + 1 and np.allclose(factor @ factor.T, v, rtol=1e-9, atol=1e-12 * np.trace(v))
        values, vectors = W.one_sided_jacobi(factor)
        assert np.allclose(values[:rank], np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-6, atol=1e-12 * np.trace(v))
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: rotating the factor resolves eigenvalues far below the largest one's rounding."""
    factor = np.tril(np.random.default_rng(1).normal(size=(5, 5))) * 10.0 ** -np.arange(0, 25, 5)
    values, _ = W.one_sided_jacobi(factor)
    s = np.linalg.svd(factor / 10.0 ** -np.arange(0, 25, 5))  # column scaling apart, well conditioned
    assert len(values) == 5 and values[-1] > 0 and s[1][-1] > 0
    assert math.isclose(np.sqrt(np.prod(values)), abs(np.prod(np.diag(factor))), rel_tol=1e-12)


ODD = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (3, [-1.0, 0.0, 0.25]), (4, None), (5, []), (6, [1.0, None, 2.0]),
       (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, [0.0, 3.0, 0.5]), (3, [-1.0, 0.0, 0.25])]


def test_defined_results(spark):
    got = W.whiten(spark.createDataFrame(ODD, SCHEMA).withColumn("x", F.lit("clash")).withColumn("row", F.lit(1))).collect()
    ids = sorted({r["vec_id"] if r["vec_id"] is not None else -1 for r in got})
    assert ids == [-1, 1, 2, 3] and {r["n"] for r in got} == {3} and {r["component"] for r in got} == {1, 2}
    assert len(got) == 5 * 2  # the repeated row 3 comes twice
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert by[1, 1] == by[2, 1]
    _, deviations, *_ = brute([v for _, v in ODD if v and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)])
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviations)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert W.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries_neither_wrap_nor_crash(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i), 1e12 * i]) for i in range(6)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == set(range(6)) and all(r["deviation"] is None for r in got)
    big = [(i, [2.0 ** 20 * i, float(i)]) for i in range(4)]
    _, deviations, *_ = brute([v for _, v in big])
    got = W.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    assert [r["deviation"] for r in got] == deviations
