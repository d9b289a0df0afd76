"""Streaming forms of the stateless operators.

The cleaners are pure column expressions, so the same functions run on a
``readStream`` source unchanged; label counts are a streaming aggregation in
complete/update mode. Sinks write Parquet (exactly-once with the checkpoint)
under the shared checkpoint folder.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..session import scratch_path, spread


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder of part files, asked of the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def source(spark: SparkSession, sf_dir: str, table: str, schema=None, max_files: int | None = None) -> DataFrame:
    """A file stream over one table: a folder of part files, or one file beside
    other tables (a file source reads folders, so the others are filtered out).

    ``max_files`` bounds the files of a micro-batch; unset, one micro-batch takes
    all that is there and its files are read in parallel."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def finish(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for a query to end, without limit unless one is given. A failed query
    raises its error, an unfinished one is stopped and raises."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not finish in {timeout_s} s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def clean_comment_stream(stream: DataFrame, keys: list[str], keep: str, text: str = "text") -> DataFrame:
    """T9 + F4 on a stream, one column per stage."""
    return (stream.select(*keys, T.remove_emojis(text).alias("t3_no_emoji"))
            .withColumn("t4_keep_only", T.keep_only("t3_no_emoji", keep))
            .withColumn("t5_final", T.drop_chars("t4_keep_only"))
            .withColumn("is_empty", T.is_empty("t5_final")))


def label_counts_stream(stream: DataFrame, label: str) -> DataFrame:
    """A1 as a streaming aggregation (emit in complete or update mode)."""
    return stream.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def run_available(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                  timeout_s: float | None = None) -> str:
    """Process everything available now, write it to a fresh folder under the
    checkpoint dir and return the folder. Restarting with the same folder
    resumes from the stored offsets."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    w = (df.writeStream.outputMode(mode).format(fmt).option("path", out + "/data")
         .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True))
    q: StreamingQuery = w.start()
    finish(q, timeout_s)
    return out + "/data"


def run_available_batches(stream: DataFrame, transform, name: str, key: str | Sequence[str] | None = None,
                          timeout_s: float | None = None, out: str | None = None) -> str:
    """Process everything available now with a batch operator per micro-batch.

    ``foreachBatch`` hands each micro-batch over as a plain DataFrame: it is
    hash-spread by ``key`` (the whole unique row key) only when its scan has fewer partitions than the
    cluster runs tasks (a micro-batch of one large file or row group), then
    ``transform`` (the same DataFrame -> DataFrame operator as in batch) runs
    and the result is written to the batch's own folder with overwrite, so a
    replayed micro-batch replaces its own output (exactly-once files).
    Returns the data folder (one ``batch=<id>`` partition per micro-batch).
    Passing the ``out`` folder of an earlier run resumes from its checkpoint:
    only data that arrived since is processed.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        b = spread(batch, *([key] if isinstance(key, str) else key)) if key else batch
        transform(b).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q: StreamingQuery = (stream.writeStream.foreachBatch(sink)
                         .option("checkpointLocation", out + "/_checkpoint")
                         .trigger(availableNow=True).start())
    finish(q, timeout_s)
    return out + "/data"
