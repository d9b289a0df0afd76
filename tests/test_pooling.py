"""Pooling of looked-up token vectors: both forms against a plain loop."""
import math

import numpy as np
import pytest

from lexiframe.operators import pooling as P

DIM = 5
VECTORS = {i: [math.sin(i * (j + 1)) for j in range(DIM)] for i in range(0, 60)}


def tables(spark, more=()):
    rows = [(i, v, "x") for i, v in VECTORS.items()] + list(more)
    return spark.createDataFrame(rows, "id int, vector array<double>, n_pooled string").repartition(3)


def encoded(spark, rows):
    return spark.createDataFrame([(k, i, m, "x", "y") for k, i, m in rows],
                                 "k long, input_ids array<int>, attention_mask array<int>, key string, _rid string").repartition(4)


def plain(rows):
    out = []
    for k, ids, mask in rows:
        kept = [VECTORS[i] for i, m in zip(ids or [], mask or []) if m == 1 and i in VECTORS]
        x = np.array(kept).reshape(-1, DIM)
        out.append((str(k), len(kept), [round(float(v), 9) for v in [*x.max(axis=0), *x.mean(axis=0)]] if kept else None))
    return sorted(out, key=str)


def pooled(spark, rows, limit, more=()):
    got = P.pooled_tokens(encoded(spark, rows), "k", tables(spark, more), DIM, limit=limit)
    assert got.columns == ["k", "n_pooled", "max_pool", "features", "tanh"]
    out = []
    for r in got.collect():
        f = None if r["features"] is None else [round(v, 9) + 0.0 for v in r["features"]]
        assert (r["max_pool"] is None) == (r["tanh"] is None) == (f is None)
        if f:
            assert r["max_pool"] == r["features"][:DIM] and r["tanh"] == pytest.approx([math.tanh(v) for v in r["features"]])
        out.append((str(r["k"]), r["n_pooled"], f))
    return sorted(out, key=str)


def drawn():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(150):
        n = int(rng.integers(0, 30))
        ids = [int(i) for i in rng.integers(0, 66, n)]  # 60 to 65 have no vector
        ids = [7] * (n // 3) + ids[n // 3:]  # id 7 holds a third
        rows.append((k, [*ids, 0, 0], [1] * n + [0, 0]))
    rows += [(None, [1, 2], [1, 1]), (None, [3], [1]), (5, [9, 9, 9], [1, 1, 1]), (5, [9, 9, 9], [1, 1, 1]), (900, None, None),
             (901, [], []), (902, [99], [1]), (903, [1, None, 2], [1, 1, 1]), (904, [5] * 5000 + [6], [1] * 5001), (905, [1, 2], [0, 0])]
    return rows


@pytest.mark.parametrize("limit", [P.BROADCAST_BYTES, 0])
def test_both_forms_equal_a_plain_loop(spark, limit, monkeypatch):
    monkeypatch.setattr(P, "HOT_SHARE", 10)
    odd = [(None, [1.0] * DIM, "x"), (61, None, "x"), (62, [1.0] * 4, "x"), (63, [1.0] * 4 + [None], "x")]
    assert pooled(spark, drawn(), limit, odd) == plain(drawn())


@pytest.mark.parametrize("limit", [P.BROADCAST_BYTES, 0])
def test_empty_sides(spark, limit):
    assert pooled(spark, [], limit) == []
    none = P.pooled_tokens(encoded(spark, drawn()[:9]), "k", tables(spark).limit(0), DIM, limit=limit - 1 if limit else -1)
    assert {(r["n_pooled"], r["features"]) for r in none.collect()} == {(0, None)}


def test_steps_cut_rows_anywhere(monkeypatch):
    rng = np.random.default_rng(2)
    rows, matrix = np.sort(rng.integers(0, 9, 100)), rng.normal(size=(20, 3))
    at = rng.integers(0, 20, 100)
    for cells in (1, 3, 7, 30, 1 << 20):
        monkeypatch.setattr(P, "STEP_CELLS", cells)
        most, total = P.segment_pool(rows, at, matrix, 12)
        for r in range(12):
            x = matrix[at[rows == r]]
            assert np.allclose(total[r], x.sum(axis=0))
            assert (most[r] == (x.max(axis=0) if len(x) else -np.inf)).all()


def test_small_table_moves_no_rows(spark):
    plan = P.pooled_tokens(encoded(spark, drawn()).coalesce(1), "k", tables(spark), DIM)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_only_rarely_used_vectors_are_joined_by_shuffle(spark):
    rows = drawn()
    used = {}
    for _, ids, mask in rows:
        for i, m in zip(ids or [], mask or []):
            used[i] = used.get(i, 0) + (m == 1 and i is not None)
    few = 20 * (8 * DIM + 4)
    assert few < len(VECTORS) * (8 * DIM + 4)
    assert pooled(spark, rows, few) == plain(rows)
    inner = encoded(spark, rows).select(P._kept("input_ids", "attention_mask").alias("ids"))
    ids = {r["id"] for r in P._most_used(inner, 20).collect()}
    assert 7 in ids and 0 < len(ids) <= 21
    assert min(used[i] for i in ids) >= max(n for i, n in used.items() if i is not None and i not in ids)
