"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import range_partitions
from ..session import materialize

TEXT_BATCH_ROWS = 512
BITMAP_WORDS = 1 << 20
STEP_BYTES = 4 << 20  # text bytes of a numpy step


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound the rows of one Arrow batch, since Arrow has no bound in bytes:
    a batch of long texts must fit a Python worker beside the next one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def strings(column: pa.Array) -> list[str]:
    """The column's texts, null as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the row offsets (n + 1), null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if large else np.int32, n + 1 + column.offset)[column.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def byte_slices(column: pa.Array, most: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Consecutive rows of a text column, at most ``most`` bytes at a time (a longer text alone)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield column.slice(at, stop - at)
        at = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (murmur-style constants): spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def may_hold(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among that of ``keys``: none is missed, few others stay.

    A bitmap of hashed keys (at most BITMAP_WORDS rows of 64 bits, whatever the
    input) is broadcast, so that a following join moves few wide rows."""
    def bit(c: str):
        return F.pmod(F.xxhash64(c), F.lit(BITMAP_WORDS * 64))

    words = (keys.select(bit(column).alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(__bit & 63 as int)))").alias("__bits")))
    held = df.withColumn("__bit", bit(column)).join(F.broadcast(words), F.shiftright("__bit", 6) == F.col("__word"))
    return held.where(F.expr("__bits & shiftleft(1L, cast(__bit & 63 as int))") != 0).drop("__bit", "__word", "__bits")


def running_total(df: DataFrame, order_by: Sequence[str], value: str, out: str, name: str) -> DataFrame:
    """Add ``out`` = the sum of ``value`` (long, not null) over all rows up to
    and including this one in ``order_by`` order, without a single-task window.

    Rows are range-partitioned on the whole order tuple (a hot leading value is
    cut through), summed within each range, and written once; one total per
    range (as many rows as ranges, whatever the input) gives the offsets.
    Rows that tie on the whole tuple may come in any order.
    """
    n = range_partitions(df)
    ranged = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    schema = ranged.withColumn("__pid", F.lit(0)).withColumn("__local", F.lit(0).cast("long")).schema
    at = df.columns.index(value)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid, total = TaskContext.get().partitionId(), 0
        for b in batches:
            run = total + np.cumsum(b.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
            if len(run):
                total = int(run[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(run), pid, np.int32)), pa.array(run)],
                names=[*b.schema.names, "__pid", "__local"])

    part = materialize(ranged.mapInArrow(sums, schema), name)
    # one row per range: a window over at most n rows
    offsets = (part.groupBy("__pid").agg(F.max("__local").alias("__sum"))
               .select(F.col("__pid").alias("__p"),
                       (F.sum("__sum").over(Window.orderBy("__pid")) - F.col("__sum")).alias("__before")))
    return (part.join(F.broadcast(offsets), F.col("__pid") == F.col("__p"))
            .withColumn(out, F.col("__before") + F.col("__local"))
            .drop("__pid", "__p", "__local", "__before"))
