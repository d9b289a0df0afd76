"""Stateless operators run unchanged on a stream; aggregations run in complete mode."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF01
from lexiframe.functions.charsets import CharSet
from lexiframe.functions.constants import LATIN_RANGES
from lexiframe.operators import splits as D
from lexiframe.session import read_table
from lexiframe.streaming.stream import (
    clean_comment_stream, finish, label_counts_stream, run_available, run_available_batches, source,
)


def test_stream_cleaning_equals_batch_cleaning(spark):
    keep = CharSet(LATIN_RANGES)
    out = run_available(clean_comment_stream(source(spark, SF01, "conversations"), ["conv_id", "turn"], keep),
                        "t-stream")
    streamed = spark.read.parquet(out)
    batch = clean_comment_stream(read_table(spark, SF01, "conversations"), ["conv_id", "turn"], keep)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_micro_batches_spread_and_match_batch(spark):
    keep = CharSet(LATIN_RANGES)
    s = source(spark, SF01, "documents").select("doc_id", "text")
    out = run_available_batches(s, lambda b: clean_comment_stream(b, ["doc_id"], keep), "t-stream-mb", "doc_id")
    streamed = spark.read.parquet(out)
    assert "batch" in streamed.columns
    streamed = streamed.drop("batch")
    batch = clean_comment_stream(read_table(spark, SF01, "documents"), ["doc_id"], keep)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_hash_split_runs_on_a_stream(spark):
    s = D.hash_split(source(spark, SF01, "documents").select("doc_id"), "doc_id")
    out = run_available(s, "t-stream-split")
    streamed = spark.read.parquet(out)
    batch = D.hash_split(read_table(spark, SF01, "documents").select("doc_id"), "doc_id")
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count()


def test_label_counts_complete_mode(spark):
    s = source(spark, SF01, "labels").select(F.col("quality").alias("Sentiment"))
    name = "lf_counts_" + os.path.basename(tempfile.mkdtemp())
    q = (label_counts_stream(s, "Sentiment").writeStream.outputMode("complete").format("memory")
         .queryName(name).trigger(availableNow=True).start())
    finish(q)
    got = {r["Sentiment"]: r["n_rows"] for r in spark.table(name).collect()}
    want = {r["quality"]: r["count"] for r in read_table(spark, SF01, "labels").groupBy("quality").count().collect()}
    assert got == want


def test_micro_batch_runner_resumes_without_duplicates(spark):
    keep = CharSet(LATIN_RANGES)
    s = source(spark, SF01, "conversations").select("conv_id", "turn", "text")
    clean = lambda b: clean_comment_stream(b, ["conv_id", "turn"], keep)
    data = run_available_batches(s, clean, "t-stream-resume", ["conv_id", "turn"])
    first = spark.read.parquet(data).count()
    again = run_available_batches(s, clean, "t-stream-resume", ["conv_id", "turn"], out=data[: -len("/data")])
    assert again == data
    assert spark.read.parquet(data).count() == first == read_table(spark, SF01, "conversations").count()


def test_a_folder_of_part_files_streams_whole(spark, tmp_path):
    labels = read_table(spark, SF01, "labels").repartition(3)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    read_table(spark, SF01, "documents").limit(5).write.parquet(str(tmp_path / "documents.parquet"))
    assert len(list((tmp_path / "labels.parquet").glob("part-*"))) == 3
    out = run_available(source(spark, str(tmp_path), "labels"), "t-stream-folder")
    streamed = spark.read.parquet(out)
    assert streamed.count() == labels.count() and streamed.exceptAll(labels).count() == 0


def test_failed_and_unfinished_streams_raise(spark):
    import pytest

    def fail(batch, _):
        raise ValueError("no")

    s = source(spark, SF01, "labels")
    with pytest.raises(Exception):
        finish(s.writeStream.foreachBatch(fail).option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    endless = spark.readStream.format("rate").load().writeStream.format("noop").option(
        "checkpointLocation", tempfile.mkdtemp()).trigger(processingTime="1 second").start()
    with pytest.raises(TimeoutError):
        finish(endless, 2)
    assert not endless.isActive
