"""Mini-batch training over seeded random batches (E14 -> A5, A10): local steps, weights averaged once an epoch.

The examples are dealt into batches once (E14), a batch being one row that holds its examples in key order, so no task
holds more than a batch at a time. An epoch deals the train batches anew over ``shards`` tasks by a seeded hash; a task
takes an Adam step a batch, in the order of the hash, from the weights all tasks share, and hands over one row of figures
a batch and its last weights. Those are averaged by rows trained, as decimals, and the next epoch starts from the average.
Every order and every deal is a function of seed, epoch and batch number, and an epoch's rows are written once: a task that
runs again gives the same rows, and the result does not depend on the cluster.

Examples without a key, or with a NULL weight, a label outside 0..classes-1, a phase other than train, valid and test, or
features that are NULL, of another size, or hold NULL or NaN take no part. Keys are unique. No train examples: the weights stay zero.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .encode import random_batches
from .evaluate import batch_mean_metrics
from .models import LinearScorer
from .splits import seeded_hash
from .training import PHASES, Head, _head_sums, _scorer, _unit_counts


@dataclass(frozen=True)
class BatchRun:
    """metrics: epoch, phase, batch_id, shard, n_rows, loss, accuracy, one row a batch (train batches before their step, the
    others with the epoch's averaged weights; test batches once, with the best epoch's); best and last: scorers."""
    metrics: DataFrame
    best: LinearScorer
    last: LinearScorer
    best_epoch: int


def deal_batches(examples: DataFrame, key: str, head: Head, batch_size: int, seed: int = 1234) -> DataFrame:
    """phase, batch_id, rows: E14 batches per phase, each one row with its examples (k, y, w, x) in key order."""
    vectors = "features" in examples.columns
    x = F.col("features" if vectors else "hashes")
    fits = F.col(key).isNotNull() & F.col(head.label).between(0, head.classes - 1) & F.col(head.phase).isin(*PHASES)
    fits &= x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | (F.isnan(v) if vectors else F.lit(False)))
    if vectors:
        fits &= F.size(x) == head.dim
    if head.weight:
        fits &= F.col(head.weight).isNotNull()
    weight = F.col(head.weight).cast("double") if head.weight else F.lit(1.0)
    row = F.struct(F.col(key).alias("k"), F.col(head.label).cast("int").alias("y"), weight.alias("w"), x.alias("x"))
    known = examples.where(fits).select(F.col(key).alias("k"), F.col(head.phase).alias("phase"), row.alias("row"))
    batches = random_batches(known, "k", batch_size, seed, split_col="phase")
    return materialize(batches.groupBy("phase", "batch_id").agg(F.array_sort(F.collect_list("row")).alias("rows")), "batches")


def _deal(seed: int, epoch: int, shards: int) -> tuple[Column, Column]:
    """A batch's place in the epoch's order, and its shard."""
    place = seeded_hash("batch_id", seed + epoch)
    return place, (F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % shards).cast("int")


STEP_ROWS = 512  # batches whose figures are handed over at a time
STEP_SCHEMA = "shard int, phase string, batch_id long, n_rows long, loss double, accuracy double, weights array<double>"


def _adam(w: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, step: int, rate: float):
    first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
    return w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), first, second


def _walk(head: Head, vectors: bool, shared, steps: bool):
    """Over (shard, phase, batch_id, rows): a row of figures a batch; with ``steps`` also each shard's last weights,
    times its number of rows."""
    fields = pa.schema([("shard", pa.int32()), ("phase", pa.string()), ("batch_id", pa.int64()), ("n_rows", pa.int64()),
                        ("loss", pa.float64()), ("accuracy", pa.float64()), ("weights", pa.list_(pa.float64()))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, step, out = None, 0, 0, []
        w = first = second = None

        def ending() -> list[tuple]:
            return [(shard, None, None, seen, None, None, (w * seen).reshape(-1).tolist())] if steps and shard is not None else []

        for b in batches:
            shards, phases, ids = (b.column(i).to_pylist() for i in range(3))
            for r in range(b.num_rows):
                if w is None or (steps and shards[r] != shard):
                    out += ending()
                    shard, seen, step, w = shards[r], 0, 0, shared.value
                    first = second = np.zeros_like(w)
                rows = b.column(3).slice(r, 1).flatten()
                x = rows.field("x")
                flat = x.flatten().to_numpy()
                x = flat.reshape(-1, head.dim) if vectors else _unit_counts(flat, x.value_lengths().to_numpy(), head.dim)
                y, weight = rows.field("y").to_numpy().astype(np.int64), rows.field("w").to_numpy()
                sums = _head_sums(x, y, weight, np.full(len(y), PHASES[0]), w)
                n, total, loss, hits = sums[:4]
                out.append((shards[r], phases[r], ids[r], int(n), float(loss / total) if total else None, float(hits / n), None))
                if steps:
                    seen += int(n)
                    if total:
                        step += 1
                        g = sums[4 * len(PHASES):].reshape(w.shape) / total
                        g[:-1] += head.settings.weight_decay * w[:-1]
                        w, first, second = _adam(w, first, second, g, step, head.settings.learning_rate)
                if len(out) >= STEP_ROWS:
                    yield table(out)
                    out = []
        out += ending()
        if out:
            yield table(out)

    return walk


def _averaged(steps: DataFrame, w: np.ndarray) -> np.ndarray:
    """The shards' weights averaged by rows trained (a fixed number of sums reaches the driver)."""
    last = steps.where("weights IS NOT NULL")
    rows = (last.select("n_rows", F.posexplode("weights").alias("i", "v")).groupBy("i")
            .agg(F.sum(F.col("v").cast("decimal(38,18)")).alias("v"), F.sum("n_rows").alias("n")).collect())
    out = w.copy().reshape(-1)
    for r in rows:
        out[r["i"]] = float(r["v"]) / r["n"]
    return out.reshape(w.shape)


def epoch_means(metrics: DataFrame) -> DataFrame:
    """A5 of every epoch and phase: the unweighted means of the batches' figures, with the numbers of batches and rows."""
    means = batch_mean_metrics(metrics, "batch_id", "accuracy", "loss", ("epoch", "phase"))
    rows = metrics.groupBy("epoch", "phase").agg(F.sum("n_rows").alias("n_rows"))
    return means.select("epoch", "phase", "n_batches", "mean_batch_accuracy", "mean_batch_loss").join(rows, ["epoch", "phase"])


def _mean_loss(metrics: DataFrame) -> float | None:
    """Mean of the batches' losses, added up as decimals: the same whatever the order."""
    mean = metrics.agg(F.avg(F.col("loss").cast("decimal(30,18)"))).first()[0]
    return None if mean is None else float(mean)


def fit_batches(batches: DataFrame, head: Head, shards: int = 8, seed: int = 1234) -> BatchRun:
    """Train ``head`` on what :func:`deal_batches` returns, with one row of figures per batch and epoch.

    ``shards``: tasks that step side by side, part of the result (as the seed is). The best epoch has the lowest mean of the
    valid batches' losses (no valid batches: the train batches'), the first of equals."""
    sc = batches.sparkSession.sparkContext
    vectors = not batches.schema["rows"].dataType.elementType["x"].dataType.elementType.simpleString() == "bigint"
    w = np.zeros((head.dim + 1, head.classes))
    best, best_epoch, lowest, tables = w, 0, None, []

    def walked(rows: DataFrame, weights: np.ndarray, steps: bool, name: str) -> DataFrame:
        return materialize(rows.select("shard", "phase", "batch_id", "rows")
                           .mapInArrow(_walk(head, vectors, sc.broadcast(weights), steps), STEP_SCHEMA), name)

    def judged(phase: str, weights: np.ndarray) -> DataFrame:
        rows = batches.where(F.col("phase") == phase).withColumn("shard", F.lit(None).cast("int"))
        return walked(rows, weights, False, f"batches-{phase}")

    for epoch in range(1, head.settings.epochs + 1):
        place, shard = _deal(seed, epoch, shards)
        dealt = (batches.where(F.col("phase") == "train").withColumn("place", place).withColumn("shard", shard)
                 .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "batch_id"))
        steps = walked(dealt, w, True, "batch-steps")
        w = _averaged(steps, w)
        train, valid = steps.where("batch_id IS NOT NULL"), judged("valid", w)
        tables += [t.withColumn("epoch", F.lit(epoch)) for t in (train, valid)]
        loss = _mean_loss(valid)
        loss = _mean_loss(train) if loss is None else loss
        if best_epoch == 0 or (loss is not None and loss < lowest):
            best, best_epoch, lowest = w, epoch, np.inf if loss is None else loss
    tables.append(judged("test", best).withColumn("epoch", F.lit(best_epoch)))
    metrics = tables[0]
    for t in tables[1:]:
        metrics = metrics.unionByName(t)
    return BatchRun(metrics.select("epoch", "phase", "batch_id", "shard", "n_rows", "loss", "accuracy"), _scorer(best), _scorer(w), best_epoch)
