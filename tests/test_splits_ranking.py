"""Exact split sizes, disjointness, and the two-level rank against brute force."""
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiframe.operators import encode as E
from lexiframe.operators import splits as D
from lexiframe.operators.ranking import ordered_index


@pytest.mark.parametrize("n", [11807, 2000, 1700, 7, 1])
def test_test_split_is_exact(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    out = D.train_test_split(df, "k").groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in out}
    assert counts.get("test", 0) == math.ceil(0.15 * n)
    assert counts.get("test", 0) + counts.get("train", 0) == n


@pytest.mark.parametrize("rule,n,expected", [("floor", 10035, 8529), ("round", 10035, 8530),
                                             ("floor", 1700, 1445), ("round", 1700, 1445)])
def test_valid_split_rules(spark, rule, n, expected):
    df = spark.range(n).withColumnRenamed("id", "k").withColumn("split", F.lit("train"))
    out = D.train_valid_split(df, "k", rule=rule).where(F.col("split") == "train").count()
    assert out == expected


def test_split_matches_global_rank(spark):
    n = 3000
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r["k"]: r["split"] for r in D.train_test_split(df, "k").collect()}
    h = D.seeded_hash("k", 42)
    ranked = df.withColumn("_h", h).withColumn("rn", F.row_number().over(Window.orderBy("_h", "k")))
    k = math.ceil(0.15 * n)
    want = {r["k"]: ("test" if r["rn"] <= k else "train") for r in ranked.collect()}
    assert got == want


def test_ordered_index_with_a_hot_leading_value(spark):
    # a third of the rows share one length: the range bounds cut through it
    rows = [(i, 400 if i % 3 == 0 else i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, len int")
    got = ordered_index(df, ["len", "k"], name="idx", n_ranges=16)
    want = df.withColumn("idx", F.row_number().over(Window.orderBy("len", "k")) - 1)
    assert sorted(map(tuple, got.select("k", "idx").collect())) == sorted(map(tuple, want.select("k", "idx").collect()))


def test_batches_are_full_except_last(spark):
    df = spark.range(100).withColumnRenamed("id", "k").withColumn("split", F.lit("train"))
    sizes = sorted(r["count"] for r in E.sequential_batches(df, "k", 32).groupBy("batch_id").count().collect())
    assert sizes == [4, 32, 32, 32]
    rsizes = sorted(r["count"] for r in E.random_batches(df, "k", 32).groupBy("batch_id").count().collect())
    assert rsizes == [4, 32, 32, 32]


def test_hash_split_is_stateless_and_close(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    share = D.hash_split(df, "k").where(F.col("split") == "test").count() / 20000
    assert abs(share - 0.15) < 0.02


def test_split_plan_keeps_wide_rows_narrow(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("payload", F.repeat(F.lit("x"), 10))
    plan = D.train_test_split(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_renumber_many_ranges_and_positions(spark):
    from lexiframe.operators import shape
    rows = [(p, k * 7 + p, k) for p in (0, 1) for k in range(500)]
    df = spark.createDataFrame(rows, "part int, k1 long, k2 long")
    got = shape.renumber(df, ["k1", "k2"], part_col="part")
    want = df.withColumn("row_id", F.row_number().over(Window.orderBy("part", "k1", "k2")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    picked = shape.renumber(df, ["k1", "k2"], part_col="part", positions=[0, 499, 500, 999])
    assert sorted(r["row_id"] for r in picked.collect()) == [0, 499, 500, 999]
    assert shape.row_at(df, 733, ["part", "k1", "k2"]).collect()[0]["pos"] == 733


def test_positions_join_back_wide_rows(spark):
    from lexiframe.operators import shape
    df = spark.range(2000).withColumnRenamed("id", "k").withColumn("payload", F.repeat(F.lit("x"), 5))
    got = shape.renumber(df, ["k"], name="pos", positions=[0, 7, 1999])
    assert sorted((r["pos"], r["k"], r["payload"]) for r in got.collect()) == [
        (0, 0, "xxxxx"), (7, 7, "xxxxx"), (1999, 1999, "xxxxx")]


def test_grouped_index_restarts_per_group(spark):
    rows = [(("a", "b", "c")[i % 3], (i * 7919) % 10007) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = ordered_index(df, ["k"], ["g"], name="idx", n_ranges=7)
    want = df.withColumn("idx", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert sorted(map(tuple, got.select("g", "k", "idx").collect())) == \
        sorted(map(tuple, want.select("g", "k", "idx").collect()))


def test_clustered_keys_keep_ranges_balanced(spark):
    # a third of the rows sit in a dense block of ids, the rest are spread over a
    # huge id space: range bounds on the key itself still balance the partitions
    n = 6000
    rows = [(i,) for i in range(n // 3)] + [(10**6 + i * 10**9,) for i in range(n - n // 3)]
    df = spark.createDataFrame(rows, "k long")
    got = ordered_index(df, ["k"], name="idx", n_ranges=12)
    want = df.withColumn("idx", F.row_number().over(Window.orderBy("k")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("k", "idx").collect()))
    sizes = [r["count"] for r in df.repartitionByRange(12, "k").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < n / 3


def test_duplicate_keys_empty_for_a_valid_index(spark):
    from lexiframe.operators import shape
    df = spark.range(50).withColumnRenamed("id", "epoch")
    assert shape.duplicate_keys(df, "epoch").count() == 0
    assert shape.duplicate_keys(df.union(spark.range(3).withColumnRenamed("id", "epoch")), "epoch").count() == 3


def test_renumber_with_one_hot_leading_value(spark):
    # one conversation holds a third of the turns: the range bounds split it
    from lexiframe.operators import shape
    rows = [(0, t) for t in range(400)] + [(c, t) for c in range(1, 200) for t in range(4)]
    df = spark.createDataFrame(rows, "conv long, turn long")
    got = shape.renumber(df, ["conv", "turn"])
    want = df.withColumn("row_id", F.row_number().over(Window.orderBy("conv", "turn")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sizes = [r["count"] for r in df.repartitionByRange(8, "conv", "turn")
             .groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 400


def test_row_ids_do_not_depend_on_arrival_order(spark):
    # the same partition content arriving in another order (as after a re-run
    # shuffle read) gets the same ids, so a retried task re-emits the same groups
    from lexiframe.operators.ranking import with_row_ids
    rows = [(i % 7, f"t{i}") for i in range(200)]
    a = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    b = spark.createDataFrame(list(reversed(rows)), "k long, t string").coalesce(1)
    ids = [{(r["k"], r["t"]): r["_rid"] for r in with_row_ids(d, "k", F.col("t")).collect()} for d in (a, b)]
    assert ids[0] == ids[1] and len(set(ids[0].values())) == len(rows)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_index_aligned_join_equals_full_outer(spark, limit):
    from lexiframe.operators import shape
    left = spark.createDataFrame([(k, f"x{k}") for k in range(0, 60)] + [(None, "xn")] + [(3, "x3b")] * 30,
                                 "row_id long, Data string")
    right = spark.createDataFrame([(k, k % 2) for k in range(40, 90)] + [(None, 1)] + [(3, 0)] * 2,
                                  "row_id long, Sentiment int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit or -1))
    got = shape.index_aligned_join(left, right, "row_id")
    want = left.join(right, on="row_id", how="full_outer")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_spread_by_full_row_key_splits_a_hot_conversation(spark):
    from lexiframe.session import spread
    rows = [(0, t) for t in range(600)] + [(c, t) for c in range(1, 301) for t in range(4)]
    df = spark.createDataFrame(rows, "conv long, turn long").coalesce(1)
    out = spread(df, "conv", "turn")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.rdd.getNumPartitions() > 1 and max(sizes) < 600
    assert out.count() == len(rows)


def test_grouped_positions(spark):
    rows = [(("a", "b", "c")[i % 3], (i * 7919) % 10007, f"p{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, payload string")
    got = ordered_index(df, ["k"], ["g"], name="idx", positions=[0, 5, 299], n_ranges=7)
    want = (df.withColumn("idx", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
            .where(F.col("idx").isin(0, 5, 299)))
    assert sorted(map(tuple, got.select("g", "k", "payload", "idx").collect())) == \
        sorted(map(tuple, want.select("g", "k", "payload", "idx").collect()))


def test_ordered_index_property_against_row_number(spark):
    from hypothesis import HealthCheck, given, settings, strategies as st

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 9), st.booleans())
    def check(leads, n_ranges, grouped):
        rows = [(("x", "y")[i % 2] if grouped else "x", lead, i) for i, lead in enumerate(leads)]
        df = spark.createDataFrame(rows, "g string, lead int, k long")
        parts = ["g"] if grouped else []
        got = ordered_index(df, ["lead", "k"], parts, name="idx", n_ranges=n_ranges)
        w = Window.partitionBy(*parts).orderBy("lead", "k") if parts else Window.orderBy("lead", "k")
        want = df.withColumn("idx", F.row_number().over(w) - 1)
        assert sorted(map(tuple, got.select("g", "lead", "k", "idx").collect())) == \
            sorted(map(tuple, want.select("g", "lead", "k", "idx").collect()))

    check()


def test_a_repeated_split_key_raises(spark):
    from lexiframe.operators import splits as D
    df = spark.createDataFrame([(i % 10,) for i in range(100)], "k long")
    with pytest.raises(ValueError):
        D.train_test_split(df, "k")
    assert D.train_test_split(df.distinct(), "k").count() == 10
