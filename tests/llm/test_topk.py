import math

import pytest
from pyspark.sql import functions as F

from lexiframe.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, block=4):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = topk.search(df.repartition(3), F.col("vec_id") % 50 == 0, k=5, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_matches_brute_force_with_ties_nulls_and_ragged_vectors(spark):
    rows = [(i, [((i * 7 + j * 13) % 11 - 5) / 8 for j in range(5)]) for i in range(0, 180)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 5), (1150, [float("inf"), 0.0]), (None, [1.0] * 5),
             (1200, []), (1250, [0.5]), (1300, [0.0] * 9), (7777, [0.25] * 40), (7778, rows[100][1])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, block=1000) == brute(rows, 5)


def test_few_or_no_candidates(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(50, [1.0])]) == []
    assert run(spark, [(50, [1.0]), (3, [2.0])]) == [(50, 1, 3, 256 * 512)]


def test_repeated_query_is_answered_once_per_row_and_never_by_itself(spark):
    got = run(spark, [(50, [1.0]), (50, [1.0]), (3, [2.0])])
    assert got == [(50, 1, 3, 256 * 512)] * 2


def test_accumulation_of_sparse_dense_and_large_weights():
    import numpy as np
    rng = np.random.default_rng(0)
    for density, scale in ((1.0, 900), (0.3, 900), (0.02, 900), (0.5, 2**29), (1.0, 2**40), (0.1, 2**62)):
        q, c = (rng.integers(-scale, scale, (n, 30)) * (rng.random((n, 30)) < density) for n in (17, 43))
        parts = [(*np.nonzero(m), m[np.nonzero(m)]) for m in (q, c)]
        assert (topk.accumulate(*parts, 17, 43) == c.astype(object) @ q.T.astype(object)).all()


def test_scores_near_and_beyond_the_range_of_a_long(spark):
    # partial sums leave the range, the scores do not
    rows = [(50, [2.0**25, 2.0**25, 1.0]), (1, [2.0**25, -2.0**25, 3.0]), (2, [2.0**21, 2.0**20, 0.0]), (3, [0.0, 0.0, 7.0]),
            (4, [-2.0**20, -2.0**20, 0.0])]
    assert run(spark, rows) == brute(rows, 5)
    # 2^62 a component and negative scores at the end of the range
    rows = [(50, [1 / 256]), (1, [2.0**54]), (2, [-2.0**54]), (3, [-2.0**54]), (4, [0.0]), (5, [1.0])]
    assert run(spark, rows) == brute(rows, 5)
    with pytest.raises(Exception, match="does not fit a long"):  # a listed score of 2^67
        run(spark, [(50, [2.0**25, 2.0**25]), (1, [2.0**25, 2.0**25])])
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(50, [1.0]), (1, [1e300])])
