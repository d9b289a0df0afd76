"""Seeded, exact-count train/valid/test splits (D1-D5) without a global sort.

Row order is ``(md5("<seed>:<key>"), key)``; the first ``k`` rows of that order
form the first part. ``k`` follows the rounding rule of the split being
reproduced: ``ceil`` (test share of a train/test split), ``floor`` (train
share of a random split) or ``round`` (half-to-even train share).

Plan (exact, one pass over the wide rows):

1. histogram of the first four hex digits of the hash (at most 65,536 rows,
   map-side combined, reads only the key column);
2. prefix sums decide for each hash bucket: wholly first, wholly second, or the
   single *boundary* bucket;
3. inside the boundary bucket (about n/65,536 rows, key column only) a window
   finds the k-th smallest ``(hash, key)``, a one-row threshold;
4. the wide rows are classified by a broadcast join with the bounded bucket
   table - a narrow operation, no shuffle of the wide rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_PREFIX = 4  # hex digits -> at most 16**4 = 65,536 buckets (proven broadcast bound)


def seeded_hash(key: str | Column, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def _first_count(n: Column, share: float, rule: str) -> Column:
    x = F.lit(float(share)) * n.cast("double")
    if rule == "ceil":
        return F.ceil(x).cast("long")
    if rule == "floor":
        return F.floor(x).cast("long")
    if rule == "round":
        return F.bround(x, 0).cast("long")
    raise ValueError(f"unknown rounding rule {rule!r}")


def exact_split(df: DataFrame, key: str, seed: int, share: float, rule: str,
                first: str, second: str, out: str = "split", only: Column | None = None,
                unique: bool = False) -> DataFrame:
    """Add ``out`` = ``first`` for the first ``k = rule(share * n)`` rows in hash order, else ``second``.

    With ``only``, just the rows satisfying it are split (and counted); the
    others keep their value of ``out``. A repeated key cannot be cut through,
    so it raises; ``unique`` says that the caller has checked.
    """
    if not unique:
        repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).first()
        if repeated is not None:
            raise ValueError(f"split key {key} is not unique: {repeated[0]!r}")
    h = seeded_hash(key, seed)
    keys = df.where(only) if only is not None else df
    keys = keys.select(key, h.alias("_h")).withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    hist = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    everything = Window.partitionBy()
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (hist
               .withColumn("_k", _first_count(F.sum("_cnt").over(everything), share, rule))
               .withColumn("_before", F.coalesce(F.sum("_cnt").over(upto), F.lit(0)))
               .withColumn("_mode", F.when(F.col("_before") + F.col("_cnt") <= F.col("_k"), F.lit(1))
                           .when(F.col("_before") >= F.col("_k"), F.lit(2))
                           .otherwise(F.lit(0)))
               .withColumn("_need", F.col("_k") - F.col("_before")))
    boundary = F.broadcast(buckets.where(F.col("_mode") == 0).select("_b", "_need"))
    ranked = keys.join(boundary, "_b").withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    threshold = ranked.where(F.col("_rn") == F.col("_need")).select(
        "_b", F.col("_h").alias("_th"), F.col(key).alias("_tk"))
    table = buckets.select("_b", "_mode").join(threshold, "_b", "left")
    tagged = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    joined = tagged.join(F.broadcast(table), "_b", "left")
    in_first = (F.col("_mode") == 1) | (
        (F.col("_mode") == 0)
        & ((F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & (F.col(key) <= F.col("_tk")))))
    value = F.when(in_first, F.lit(first)).otherwise(F.lit(second))
    if only is not None:
        value = F.when(only, value).otherwise(F.col(out))
    return joined.withColumn(out, value).drop("_h", "_b", "_mode", "_th", "_tk")


def train_test_split(df: DataFrame, key: str, test_share: float = 0.15, seed: int = 42,
                     out: str = "split", unique: bool = False) -> DataFrame:
    """test = the first ceil(test_share * n) rows in seeded hash order."""
    return exact_split(df, key, seed, test_share, "ceil", "test", "train", out, unique=unique)


def train_valid_split(df: DataFrame, key: str, train_share: float = 0.85, seed: int = 1234,
                      rule: str = "floor", split_col: str = "split", train_value: str = "train",
                      valid_value: str = "valid", unique: bool = False) -> DataFrame:
    """D2 (rule ``floor``) / D3 (rule ``round``): split the train rows again into train/valid.

    Rows whose ``split_col`` is not ``train_value`` are left as they are.
    """
    return exact_split(df, key, seed, train_share, rule, train_value, valid_value, split_col,
                       only=F.col(split_col) == F.lit(train_value), unique=unique)


def hash_split(df: DataFrame, key: str, share: float = 0.15, seed: int = 42,
               first: str = "test", second: str = "train", out: str = "split") -> DataFrame:
    """Approximate split, per-row and stateless (works on a stream): the first
    32 bits of the seeded hash below ``share * 2**32``."""
    h32 = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, F.when(h32 < F.lit(int(share * 2 ** 32)), F.lit(first)).otherwise(F.lit(second)))


def split_shares(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Count and share of each split (shares of the pooled total of all splits)."""
    c = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
