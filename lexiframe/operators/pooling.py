"""M4 M5 over looked-up token vectors: encoded rows -> a vector table -> maximum and mean per row, and their tanh.

A table within ``BROADCAST_BYTES`` (counted first) is sent to the tasks as one matrix; a batch's flat id buffer is looked up
and reduced row by row in steps of bounded cells, and nothing is shuffled. Of a larger table the vectors of the ids that the
rows use most (counted first) are sent, as many as fit, and always those of ids that hold more than one in ``HOT_SHARE`` of all
entries (so fewer than ``HOT_SHARE`` ids). Only the other ids are joined by shuffle, summed up per row, and added to what a batch finds.

Every row gives one row, rows of equal or NULL keys each their own. Ids that are NULL, masked or without a vector take no part; a table
row with a NULL id, or a vector that is NULL, of another size or with NULL entries, is none (ids of the table are unique). A row
that is left without vectors has n_pooled 0 and NULL vectors.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import lookup as L

BROADCAST_BYTES = 64 << 20
STEP_CELLS = 1 << 21  # cells of looked-up vectors a task holds at a time
HOT_SHARE = 200


def _kept(ids: str, mask: str | None) -> Column:
    if mask is None:
        return F.col(ids)
    zipped = F.arrays_zip(F.col(ids).alias("i"), F.col(mask).alias("m"))
    return F.transform(F.filter(zipped, lambda z: z["m"] == 1), lambda z: z["i"])


def _vectors(table: DataFrame, dim: int) -> DataFrame:
    """id, vec: the usable rows of (id, vector)."""
    vec = F.col("vector").cast("array<double>")
    ok = F.col("id").isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda v: v.isNull())
    return table.where(ok).select(F.col("id").cast("int").alias("id"), vec.alias("vec"))


def segment_pool(rows: np.ndarray, at: np.ndarray, matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and sum of ``matrix[at]`` over the entries of each of ``n`` rows (``rows`` ascending); -inf and 0 where a row has none."""
    dim = matrix.shape[1]
    most, total = np.full((n, dim), -np.inf), np.zeros((n, dim))
    step = max(1, STEP_CELLS // max(dim, 1))
    for a in range(0, len(rows), step):
        r, x = rows[a:a + step], matrix[at[a:a + step]]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        which = r[starts]  # a row cut by a step goes on in the next one
        most[which] = np.maximum(most[which], np.maximum.reduceat(x, starts))
        total[which] += np.add.reduceat(x, starts)
    return most, total


def _sent(table: DataFrame, dim: int):
    """The table as a broadcast (ids, matrix), by rising id."""
    got = table.toArrow().combine_chunks()
    known = L.column(got, "id").to_numpy() if got.num_rows else np.zeros(0, np.int32)
    matrix = L.column(got, "vec").flatten().to_numpy().reshape(-1, dim) if got.num_rows else np.zeros((0, dim))
    order = np.argsort(known, kind="stable")
    return table.sparkSession.sparkContext.broadcast((known[order], matrix[order]))


def _looked_up(values: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``known``, whether it is there) of each id."""
    wanted = values.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    ok = values.is_valid().to_numpy(zero_copy_only=False)
    return at, ok & (known[at] == wanted if len(known) else False)


def _pooled_in_batches(inner: DataFrame, shared, dim: int) -> DataFrame:
    """key, n_pooled, mx, mn of ``inner``: key, ids and, if there are more columns, the number, maximum and sum of vectors found before."""
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = shared.value
        size = max(1, STEP_CELLS // dim)
        for whole in batches:
            for a in range(0, whole.num_rows, size):
                b = whole.slice(a, size)
                values, lengths, _ = L.flat(b.column(1))
                rows = np.repeat(np.arange(b.num_rows), lengths)
                at, ok = _looked_up(values, known)
                most, total = segment_pool(rows[ok], at[ok], matrix, b.num_rows)
                n = np.bincount(rows[ok], minlength=b.num_rows)
                if b.num_columns > 2:
                    some = b.column(2).is_valid().to_numpy(zero_copy_only=False)
                    n[some] += b.column(2).drop_null().to_numpy()
                    most[some] = np.maximum(most[some], b.column(3).flatten().to_numpy().reshape(-1, dim))
                    total[some] += b.column(4).flatten().to_numpy().reshape(-1, dim)
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1)), mask=pa.array(n == 0))
                         for m in (most, total / np.maximum(n, 1)[:, None])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), *lists], ["key", "n_pooled", "mx", "mn"])

    kind = inner.schema["key"].dataType.simpleString()
    return inner.mapInArrow(pool, f"key {kind}, n_pooled long, mx array<double>, mn array<double>")


def _most_used(rows: DataFrame, most: int) -> DataFrame:
    """The ids that the rows hold most often: about ``most``, and all with more than one in ``HOT_SHARE`` of the entries."""
    counts = materialize(rows.select(F.explode("ids").alias("id")).where("id IS NOT NULL").groupBy("id").agg(
        F.count(F.lit(1)).alias("n")), "id-counts")
    ids, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = total // HOT_SHARE
    if ids <= most:
        least = 0
    elif most > 0:
        least = min(least, counts.agg(F.percentile_approx("n", 1 - most / ids)).first()[0])
    return counts.where(F.col("n") > least).select("id")


def _pooled_large(inner: DataFrame, table: DataFrame, dim: int, limit: int) -> DataFrame:
    rows = materialize(inner.withColumn("_rid", F.monotonically_increasing_id()), "pooled-ids")
    shared = _sent(table.join(_most_used(rows, limit // (8 * dim + 4)), "id", "left_semi"), dim)

    @F.arrow_udf("array<int>")
    def rare(lists: pa.Array) -> pa.Array:
        values, lengths, valid = L.flat(lists)
        other = ~_looked_up(values, shared.value[0])[1] & values.is_valid().to_numpy(zero_copy_only=False)
        each = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[other], minlength=len(lengths))
        return L.lists_of(values.filter(pa.array(other)), each, valid)

    looked = rows.select("_rid", F.explode(rare("ids")).alias("id")).join(table, "id")
    v = [F.get("vec", F.lit(i)) for i in range(dim)]
    found = looked.groupBy("_rid").agg(F.count(F.lit(1)).alias("n"), *[F.max(x).alias(f"mx{i}") for i, x in enumerate(v)],
                                       *[F.sum(x).alias(f"sm{i}") for i, x in enumerate(v)])
    found = found.select("_rid", "n", *[F.array(*[F.col(f"{m}{i}") for i in range(dim)]).alias(m) for m in ("mx", "sm")])
    return _pooled_in_batches(rows.join(found, "_rid", "left").select("key", "ids", "n", "mx", "sm"), shared, dim)


def pooled_tokens(df: DataFrame, key: str, table: DataFrame, dim: int, ids: str = "input_ids", mask: str | None = "attention_mask",
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """key, n_pooled, max_pool, features (maximum, then mean), tanh of each row's token vectors; ``table``: id, vector."""
    vectors = _vectors(table, dim)
    small = vectors.count() * (8 * dim + 4) <= limit
    inner = df.select(F.col(key).alias("key"), _kept(ids, mask).cast("array<int>").alias("ids"))
    pooled = _pooled_in_batches(inner, _sent(vectors, dim), dim) if small else _pooled_large(inner, vectors, dim, limit)
    out = pooled.select(F.col("key").alias(key), "n_pooled", F.col("mx").alias("max_pool"), F.concat("mx", "mn").alias("features"))
    return out.withColumn("tanh", F.transform("features", lambda x: F.tanh(x)))
