"""Exact global positions without funnelling rows through one partition.

``row_number() OVER (ORDER BY k)`` without ``PARTITION BY`` moves every row to
a single task. :func:`ordered_index` gives the same numbers the way Spark's
own global sort spreads the work:

1. only the order columns (a narrow projection) are range-partitioned on the
   *whole* order tuple with sampled bounds (``repartitionByRange``) and sorted
   within partitions. Because the tuple ends with a unique key, the bounds cut
   through a hot leading value (every document truncated to the same length,
   one conversation holding a third of the turns, a dense cluster of ids among
   sparse ones): partitions hold about the same number of rows whatever the
   key distribution. Each row records its partition and local position, and
   this narrow table is written once under the shared checkpoint folder, so
   every later read sees the same partitions (the sampled bounds are never
   recomputed) and lost executors do not lose it;
2. a count per (partition, group) - at most ``partitions + groups`` rows, a
   bound checked before it is broadcast - gives exclusive prefix sums;
3. position = rows before the partition + local position (a narrow join).

Wide rows are joined back by the order tuple only when the input has columns
beyond it; with ``positions`` only the few wanted keys are joined back, by
broadcast, so the wide rows never move.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BROADCAST_ROWS = 2_000_000  # largest offsets / key table that is broadcast
LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | position in partition


def range_partitions(df: DataFrame) -> int:
    """Number of range partitions: the session's shuffle partition count (the
    knob a cluster is sized with), at least the number of task slots."""
    spark = df.sparkSession
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        n = 200
    try:
        n = max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle
        pass
    return max(1, n)


def ordered_index(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                  name: str = "idx", positions: Sequence[int] | None = None,
                  n_ranges: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_by`` order within ``partition_by``.

    ``order_by`` (column names) must be a total order within each group (end
    it with a unique key); rows are matched back to their position by the
    tuple ``partition_by + order_by`` (null-safe). With ``positions`` only the
    rows at those positions are returned.
    """
    keys = list(partition_by)
    cols = keys + [c for c in order_by if c not in keys]
    n = n_ranges or range_partitions(df)
    mask = F.lit((1 << LOCAL_BITS) - 1)
    ranged = (df.select(*cols).repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .select(*cols, F.spark_partition_id().alias("_p"),
                      F.monotonically_increasing_id().bitwiseAND(mask).alias("_l")))
    ranged = materialize(ranged, "rank-keys")

    n_groups = ranged.select(*keys).distinct().count() if keys else 1
    counts = ranged.groupBy("_p", *keys).agg(F.count(F.lit(1)).alias("_n"))
    # rows of the same group in earlier partitions / of earlier groups in the same partition
    earlier_parts = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    skip = (F.coalesce(F.sum("_n").over(
        Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if keys else F.lit(0))
    offsets = counts.select("_p", *keys, "_n", F.coalesce(F.sum("_n").over(earlier_parts), F.lit(0)).alias("_off"),
                            skip.alias("_skip"))
    if positions is not None:
        wanted = F.array(*[F.lit(int(p)) for p in positions])
        hit = F.exists(wanted, lambda p: (p >= F.col("_off")) & (p < F.col("_off") + F.col("_n")))
        # keep whole partitions (local positions count every group of the partition)
        offsets = offsets.join(offsets.where(hit).select("_p").distinct(), "_p")
    bound = n + n_groups
    offsets = offsets.drop("_n")
    offsets = F.broadcast(offsets) if bound <= BROADCAST_ROWS else offsets
    idx = (F.col("_off") + F.col("_l") - F.col("_skip")).cast("long")
    table = ranged.join(offsets, ["_p", *keys]).select(*cols, idx.alias(name))
    if positions is not None:
        table = table.where(F.col(name).isin([int(p) for p in positions]))
    if set(df.columns) <= set(cols):
        return table.select(*df.columns, name)
    # wide input: attach positions by the (unique) order tuple
    side = table.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(cols)], name)
    if positions is not None and len(positions) * n_groups <= BROADCAST_ROWS:
        side = F.broadcast(side)
    cond = [df[c].eqNullSafe(side[f"_r{i}"]) for i, c in enumerate(cols)]
    return df.join(side, cond).drop(*[f"_r{i}" for i in range(len(cols))])


def with_row_ids(df: DataFrame, key: str, content: Column, name: str = "_rid") -> DataFrame:
    """A per-row id that survives task retries: rows are put in a fixed order
    inside their partition, ``(key, hash of content)``, before
    ``monotonically_increasing_id`` numbers them. After a shuffle the arrival
    order of rows is not fixed, so without the local sort a re-run task could
    hand a row a different id than the attempt some reducers already read
    (duplicating one row and losing another). Rows that tie on both are
    identical, so swapping them changes nothing. Local sort only, no shuffle."""
    return (df.sortWithinPartitions(key, F.xxhash64(content))
            .withColumn(name, F.monotonically_increasing_id()))
