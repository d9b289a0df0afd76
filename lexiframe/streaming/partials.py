"""Aggregates over a stream as keyed tables of mergeable partial states.

A :class:`Partials` names the group keys and the measures, each a sum, maximum or minimum of a column expression (a count is the
sum of 1). A micro-batch is first reduced to one row per key, then merged with the table that the batch before it left; the result
is written as ``version=<batch id>``. A replayed micro-batch merges with the same predecessor and overwrites its own version, so it never
counts twice, and a version is taken as a predecessor only once its write has committed (``_SUCCESS``). The last two versions are
kept: the newest and the one that a replay of it needs.

Work per micro-batch grows with the batch and the number of keys, not with the stream. Sums of whole numbers do not depend on how
the stream was cut; sums of doubles do in their last digits. NULL keys form a group. A stream without rows gives an empty table.

Built on it: row counts (P10), column profiles (P11), longest row (E10), target counts (A2), accuracy (A4) and confusion counts
(A7), from which the batch operators make the classification report (A8).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .stream import finish

MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Partials:
    """Group keys (name -> expression) and measures (name -> (sum | max | min, expression))."""
    keys: Mapping[str, Column] = field(default_factory=dict)
    measures: Mapping[str, tuple[str, Column]] = field(default_factory=dict)

    def __post_init__(self):
        wrong = {how for how, _ in self.measures.values()} - set(MERGE)
        if wrong or not self.measures:
            raise ValueError(f"measures are one or more of {sorted(MERGE)}, not {sorted(wrong)}")

    def reduce(self, rows: DataFrame) -> DataFrame:
        """One row per key of ``rows``; none for no rows, also without keys."""
        cols = [c.alias(k) for k, c in self.keys.items()] + [c.alias(m) for m, (_, c) in self.measures.items()]
        return self.merge(rows.select(*cols))

    def merge(self, states: DataFrame) -> DataFrame:
        """States of equal keys merged into one. Decimals and longs keep their type, so states merge any number of times."""
        types = dict(states.dtypes)
        out = states.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_any"),
                                             *[MERGE[how](m).cast(types[m]).alias(m) for m, (how, _) in self.measures.items()])
        return out.where(F.col("_any") > 0).drop("_any")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the committed versions, rising."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith("version=") and fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("=")[1]) for n in done)


def merge_batch(batch: DataFrame, batch_id: int, tables: Mapping[str, Partials], out: str) -> None:
    """Merge one micro-batch into every table under ``out``."""
    spark = batch.sparkSession
    for name, partials in tables.items():
        folder = f"{out}/{name}"
        known = versions(spark, folder)
        before = [v for v in known if v < batch_id]
        state = partials.reduce(batch)
        if before:
            state = partials.merge(spark.read.parquet(f"{folder}/version={before[-1]}").unionByName(state))
        state.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        for old in before[:-1]:
            fs, p = _fs(spark, f"{folder}/version={old}")
            fs.delete(p, True)


def run_partials(stream: DataFrame, tables: Mapping[str, Partials], name: str, out: str | None = None,
                 timeout_s: float | None = None) -> str:
    """Merge all that the stream has available into the tables and return their folder (see :func:`state`). Passing the ``out`` of an
    earlier run goes on from its checkpoint."""
    out = out or scratch_path(stream.sparkSession, name)
    finish(stream.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, tables, out))
           .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).start(), timeout_s)
    return out


def state(spark: SparkSession, out: str, name: str, partials: Partials, like: DataFrame) -> DataFrame:
    """The newest state of a table; ``like`` gives the columns (a stream or a table) while nothing has been merged."""
    known = versions(spark, f"{out}/{name}")
    if known:
        return spark.read.parquet(f"{out}/{name}/version={known[-1]}")
    return partials.reduce(spark.createDataFrame([], like.schema))


def forget_last_commit(spark: SparkSession, out: str) -> int:
    """Drop the checkpoint's last commit, as if the driver had been lost between a micro-batch's write and its commit: the next
    run replays that micro-batch. Returns its id."""
    fs, p = _fs(spark, out + "/_checkpoint/commits")
    last = max(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())
    fs.delete(_fs(spark, f"{out}/_checkpoint/commits/{last}")[1], False)
    return last


# ---------------------------------------------------------------- the batch operators' partial forms

def _one() -> Column:
    return F.lit(1).cast("long")


def confusion_partials(target: str = "target", pred: str = "pred") -> Partials:
    """A7 (and A2, A4, A8 from it): rows per (target, pred)."""
    return Partials({"target": F.col(target), "pred": F.col(pred)}, {"n": ("sum", _one())})


def label_partials(label: str) -> Partials:
    """A1 A2: rows per label."""
    return Partials({label: F.col(label)}, {"n_rows": ("sum", _one())})


def accuracy_partials(target: str = "target", pred: str = "pred") -> Partials:
    """A4: rows and correct ones; NULLs are not correct."""
    ok = F.coalesce(F.col(target) == F.col(pred), F.lit(False))
    return Partials({}, {"n_rows": ("sum", _one()), "n_correct": ("sum", ok.cast("long"))})


def profile_partials(columns: Sequence[str], length: Column | None = None) -> Partials:
    """P10 P11 (and E10 with ``length``): rows, non-null values of each column, longest row."""
    measures = {"n_rows": ("sum", _one())}
    measures |= {f"nn_{i}": ("sum", F.col(c).isNotNull().cast("long")) for i, c in enumerate(columns)}
    if length is not None:
        measures["max_len"] = ("max", length)
    return Partials({}, measures)


def profile_rows(merged: DataFrame, dtypes: Sequence[tuple[str, str]]) -> DataFrame:
    """The merged profile as one row per column, as :func:`lexiframe.operators.shape.column_profile` gives it."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(f"nn_{i}").alias("non_null"))
                     for i, (c, t) in enumerate(dtypes)])
    return merged.select(F.explode(rows).alias("r"), "n_rows").select("r.*", "n_rows")
