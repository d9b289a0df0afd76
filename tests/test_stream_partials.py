"""Merged partial states equal the batch operators however the stream was cut, also after replays."""
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import evaluate as A
from lexiframe.operators import shape as P
from lexiframe.streaming.partials import (
    Partials, accuracy_partials, confusion_partials, forget_last_commit, label_partials, merge_batch, profile_partials, profile_rows,
    run_partials, state, versions,
)
from lexiframe.streaming.stream import source

ROWS = [(i, i % 3 if i % 7 else None, i % 2, "x" * (i % 11)) for i in range(60)]
SCHEMA = "k int, target int, pred int, t string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def tables():
    return {"confusion": confusion_partials(), "accuracy": accuracy_partials(), "target": label_partials("target"),
            "profile": profile_partials(["k", "target", "pred", "t"], F.length("t").cast("long"))}


def check(spark, out, df):
    at = {n: state(spark, out, n, p, df) for n, p in tables().items()}
    assert rows_of(at["confusion"]) == rows_of(A.confusion(df))
    assert rows_of(A.classification_report(at["confusion"].dropna())) == rows_of(A.classification_report(A.confusion(df).dropna()))
    assert rows_of(at["target"]) == rows_of(A.label_distribution(df, "target"))
    assert rows_of(at["accuracy"]) == rows_of(A.accuracy(df).select("n_rows", "n_correct"))
    assert rows_of(profile_rows(at["profile"], df.dtypes)) == rows_of(P.column_profile(df).select("column_name", "dtype", "non_null", "n_rows"))
    assert at["profile"].first()["max_len"] == 10


def test_streamed_states_equal_batch_operators_after_a_replay_and_a_resume(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    folder = str(tmp_path / "in" / "rows.parquet")
    df.where("k < 40").repartition(3, "k").write.parquet(folder)
    stream = source(spark, str(tmp_path / "in"), "rows", df.schema, max_files=1)
    out = run_partials(stream, tables(), "t-partials")
    check(spark, out, df.where("k < 40"))
    assert len(versions(spark, out + "/confusion")) == 2
    again = forget_last_commit(spark, out)
    run_partials(stream, tables(), "t-partials", out)
    assert versions(spark, out + "/confusion")[-1] == again
    check(spark, out, df.where("k < 40"))
    df.where("k >= 40").coalesce(1).write.mode("append").parquet(folder)
    run_partials(stream, tables(), "t-partials", out)
    check(spark, out, df)


def test_a_half_written_version_is_no_predecessor(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out, part = str(tmp_path / "s"), {"confusion": confusion_partials()}
    merge_batch(df.where("k < 30"), 0, part, out)
    merge_batch(df.where("k < 10"), 1, part, out)
    (tmp_path / "s" / "confusion" / "version=1" / "_SUCCESS").unlink()  # the write of batch 1 was cut off
    merge_batch(df.where("k >= 30"), 1, part, out)
    assert rows_of(state(spark, out, "confusion", part["confusion"], df)) == rows_of(A.confusion(df))


def test_empty_batches_and_streams(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    part = tables()
    assert state(spark, str(tmp_path / "none"), "confusion", part["confusion"], df).collect() == []
    merge_batch(df, 0, part, str(tmp_path / "e"))
    assert state(spark, str(tmp_path / "e"), "accuracy", part["accuracy"], df).collect() == []
    merge_batch(spark.createDataFrame(ROWS, SCHEMA), 1, part, str(tmp_path / "e"))
    check(spark, str(tmp_path / "e"), spark.createDataFrame(ROWS, SCHEMA))


def test_measures_are_checked():
    with pytest.raises(ValueError):
        Partials({}, {"x": ("avg", F.lit(1))})
    with pytest.raises(ValueError):
        Partials({}, {})


def test_streamed_files_grow_in_number_with_the_scans(spark, monkeypatch):
    from lexiframe import session
    from lexiframe.plans import queries as Q
    df = spark.createDataFrame(ROWS, SCHEMA)
    part = tables()["confusion"]
    folders, keep = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: folders.append(keep(s, name)) or folders[-1])
    out = Q._streamed(spark, df, "k", {"confusion": part}, "streamed", [df.repartition(9), df.repartition(2)])
    assert rows_of(state(spark, out, "confusion", part, df)) == rows_of(A.confusion(df))
    files = spark.read.parquet(f"{folders[0]}/rows.parquet").select("_metadata.file_name").distinct().count()
    assert files == 12 and versions(spark, f"{out}/confusion") == [2, 3]  # 4 micro-batches of 3 files
