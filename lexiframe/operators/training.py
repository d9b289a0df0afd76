"""Training runs with history (M2, M6, M7): softmax regression, one Spark job an epoch for all configurations.

The examples stay where they are. An epoch sends every configuration's weights out; a task reads its rows once and
sums loss, hits and gradient of all configurations over them; Spark adds the sums up by position, so that
vectors of fixed sizes reach the driver. Train and validation figures of an epoch come from the same pass. Sums are
added up as decimals, so their order does not matter: the same examples give the same weights, bit for bit.

A run ends with its history, the weights of the best epoch (lowest validation loss, the first of equals) and of the
last one, and what the optimiser needs to go on; a checkpoint keeps all of it, and a run that was stopped and resumed
equals one that was not.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import LinearScorer

PHASES = ("train", "valid", "test")


@dataclass(frozen=True)
class Settings:
    """What a run is configured by (the optimiser is full-batch Adam)."""
    epochs: int = 6
    learning_rate: float = 0.05
    weight_decay: float = 0.0
    optimizer: str = "Adam"
    loss_function: str = "CrossEntropyLoss"


@dataclass(frozen=True)
class Head:
    """A configuration trained on shared examples: its label, weight and phase columns (labels outside
    0..classes-1 and NULL ones take no part; no weight column: all weigh 1), class count and feature size."""
    label: str
    classes: int
    dim: int
    settings: Settings = Settings()
    weight: str | None = None
    phase: str = "phase"


@dataclass(frozen=True)
class Optimiser:
    """What the next epoch starts from: weights (the bias in the last row) and both moments of the gradient."""
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray


@dataclass(frozen=True)
class Run:
    """history: one dict per epoch; best and last: scorers; best_epoch, last_epoch: their numbers, from 1 (0: no epoch yet)."""
    history: list[dict]
    best: LinearScorer
    last: LinearScorer
    best_epoch: int
    last_epoch: int
    next: Optimiser | None = None


def _unit_counts(hashes: np.ndarray, lengths: np.ndarray, dim: int) -> np.ndarray:
    """Log counts of each row's hashes in ``dim`` buckets, as unit vectors."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    x = np.bincount(row * dim + np.mod(hashes, dim), minlength=len(lengths) * dim).reshape(-1, dim)
    x = np.log1p(x.astype(np.float64))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def token_hashes(tokens: Column) -> Column:
    """array<long>: what :func:`fit_many` counts in as many buckets as a configuration has features."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


STEP_CELLS = 1 << 20  # feature cells, and entries of lists, that a task counts at a time


def _row_steps(lists: pa.Array, dim: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``STEP_CELLS`` feature cells and as many list entries each (a longer row alone)."""
    rows = max(1, STEP_CELLS // dim)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))
    a = 0
    while a < len(ends):
        fits = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP_CELLS, side="right"))
        b = min(max(fits, a + 1), a + rows)
        yield a, b
        a = b


def _buckets(dims: Sequence[int]) -> Column:
    """The hashes modulo the least common multiple of ``dims``, as the smallest type that holds them: every head counts them
    in the same buckets as the hashes, and a task's batches are a quarter or half as large."""
    most = math.lcm(*dims)
    kind = "short" if most < 1 << 15 else "int" if most < 1 << 31 else None
    return F.transform("hashes", lambda h: F.pmod(h, F.lit(most)).cast(kind)) if kind else F.col("hashes")


def _head_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, phase: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per phase rows, weight, weighted loss and hits, then the gradient of the train rows, as one vector."""
    z = x @ w[:-1] + w[-1]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
    hit = z.argmax(axis=1) == y
    out = []
    for name in PHASES:
        on = phase == name
        out += [on.sum(), weight[on].sum(), (weight[on] * loss[on]).sum(), hit[on].sum()]
    on = phase == "train"
    g = p[on]
    g[np.arange(on.sum()), y[on]] -= 1
    g *= weight[on][:, None]
    return np.concatenate([np.array(out, np.float64), (x[on].T @ g).reshape(-1), g.sum(axis=0)])


def _pass(examples: DataFrame, heads: Sequence[Head], weights: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The sums of every head at its weights, from one scan of ``examples``."""
    shared = examples.sparkSession.sparkContext.broadcast(list(weights))
    heads = list(heads)
    source = "features" if "features" in examples.columns else "hashes"
    columns = list(dict.fromkeys([source, *[c for h in heads for c in (h.label, h.weight, h.phase) if c]]))
    at = {c: i for i, c in enumerate(columns)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(4 * len(PHASES) + (h.dim + 1) * h.classes) for h in heads]
        for b in batches:
            phases = {c: np.array(b.column(at[c]).to_pylist()) for c in {h.phase for h in heads}}
            for dim in {h.dim for h in heads}:
                for lo, hi in _row_steps(b.column(0), dim):
                    part = b.column(0).slice(lo, hi - lo)
                    flat = part.flatten().to_numpy()
                    x = flat.reshape(-1, dim) if source == "features" else _unit_counts(flat, part.value_lengths().to_numpy(), dim)
                    for i, h in enumerate(heads):
                        if h.dim != dim:
                            continue
                        y = b.column(at[h.label]).slice(lo, hi - lo).fill_null(-1).to_numpy().astype(np.int64)
                        on = (y >= 0) & (y < h.classes)
                        weight = b.column(at[h.weight]).slice(lo, hi - lo).to_numpy() if h.weight else np.ones(len(y))
                        total[i] += _head_sums(x[on], y[on], weight[on], phases[h.phase][lo:hi][on], shared.value[i])
        yield pa.RecordBatch.from_pydict({"head": pa.array(np.arange(len(heads), dtype=np.int32)),
                                          "t": pa.array(total, pa.list_(pa.float64()))})

    read = examples.where(F.col(source).isNotNull()).select(*columns)
    if source == "hashes":
        read = read.withColumn("hashes", _buckets([h.dim for h in heads]))
    parts = read.mapInArrow(sums, "head int, t array<double>")
    rows = (parts.select("head", F.posexplode("t").alias("i", "v")).groupBy("head", "i")
            .agg(F.sum(F.col("v").cast("decimal(38,18)")).alias("v")).collect())  # a fixed number of sums per head
    out = [np.zeros(4 * len(PHASES) + (h.dim + 1) * h.classes) for h in heads]
    for r in rows:
        out[r["head"]][r["i"]] = float(r["v"])
    return out


def _scorer(weights: np.ndarray) -> LinearScorer:
    return LinearScorer(weights[:-1], weights[-1])


def _start(head: Head) -> Run:
    w = np.zeros((head.dim + 1, head.classes))
    return Run([], _scorer(w), _scorer(w), 0, 0, Optimiser(w, np.zeros_like(w), np.zeros_like(w)))


def _judged(row: dict) -> float:
    """What the best epoch is the lowest of: validation loss, else train loss."""
    return row["valid_loss"] if row["valid_loss"] is not None else row["train_loss"] or 0.0


def _advanced(run: Run, head: Head, sums: np.ndarray) -> Run:
    """``run`` after one more epoch: the figures of the weights it starts with, then one Adam step."""
    settings, now, epoch = head.settings, run.next, run.last_epoch + 1
    row: dict = {"epoch": epoch}
    for k, p in enumerate(PHASES):
        n, weight, loss, hits = sums[4 * k:4 * k + 4]
        row |= {f"{p}_loss": float(loss / weight) if weight else None, f"{p}_acc": float(hits / n) if n else None, f"n_{p}": int(n)}
    decay = settings.weight_decay * np.concatenate([now.weights[:-1], np.zeros((1, head.classes))])
    g = sums[4 * len(PHASES):].reshape(head.dim + 1, head.classes) / max(sums[1], 1e-12) + decay
    m, v = 0.9 * now.first + 0.1 * g, 0.999 * now.second + 0.001 * g * g
    w = now.weights - settings.learning_rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    better = not run.history or _judged(row) < _judged(run.history[run.best_epoch - 1])
    last = _scorer(now.weights)
    return Run([*run.history, row], last if better else run.best, last, epoch if better else run.best_epoch, epoch, Optimiser(w, m, v))


def fit_many(examples: DataFrame, heads: Sequence[Head], runs: Sequence[Run] | None = None, until: int | None = None) -> list[Run]:
    """M7: train all ``heads`` on ``examples`` (``features`` array<double> of one size, or ``hashes`` array<long> counted in
    each head's number of buckets; and the heads' columns), one scan an epoch for all that have epochs left.

    ``runs`` (M6): where each head goes on from, as :func:`load_checkpoint` returns it. ``until``: stop all after that epoch."""
    runs = [_start(h) for h in heads] if runs is None else list(runs)
    while True:
        ends = [h.settings.epochs if until is None else min(until, h.settings.epochs) for h in heads]
        on = [i for i, r in enumerate(runs) if r.last_epoch < ends[i]]
        if not on:
            return runs
        for i, sums in zip(on, _pass(examples, [heads[i] for i in on], [runs[i].next.weights for i in on])):
            runs[i] = _advanced(runs[i], heads[i], sums)


def fit(examples: DataFrame, n_classes: int, dim: int, settings: Settings, run: Run | None = None, until: int | None = None) -> Run:
    """:func:`fit_many` of one configuration: features, label int in 0..n_classes-1, weight double, phase."""
    return fit_many(examples, [Head("label", n_classes, dim, settings, "weight")], [run] if run else None, until)[0]


HISTORY = ("epoch int, train_loss double, train_acc double, n_train long, valid_loss double, valid_acc double, n_valid long, "
           "test_loss double, test_acc double, n_test long")


def save_checkpoint(spark: SparkSession, run: Run, settings: Settings, path: str) -> None:
    """M6: weights of the best and the last epoch, what the optimiser goes on from (weights and both moments), each with
    the optimiser's settings, and the history."""
    names = list(asdict(settings))
    parts = [("best", run.best_epoch, run.best), ("last", run.last_epoch, run.last)]
    if run.next:
        parts += [(name, run.last_epoch, _scorer(m)) for name, m in (
            ("next", run.next.weights), ("first_moment", run.next.first), ("second_moment", run.next.second))]
    rows = [(name, epoch, s.weights.reshape(-1).tolist(), s.bias.tolist(), *asdict(settings).values()) for name, epoch, s in parts]
    kinds = ["long" if isinstance(v, int) else "double" if isinstance(v, float) else "string" for v in asdict(settings).values()]
    schema = "name string, epoch int, weights array<double>, bias array<double>, " + ", ".join(
        f"{n} {k}" for n, k in zip(names, kinds))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    columns = [c.split()[0] for c in HISTORY.split(", ")]
    spark.createDataFrame([tuple(r[c] for c in columns) for r in run.history], HISTORY).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/history")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[Run, Settings]:
    """What :func:`save_checkpoint` wrote (a few rows)."""
    rows = {r["name"]: r for r in spark.read.parquet(f"{path}/weights").collect()}
    scorer = {k: LinearScorer(np.array(r["weights"]).reshape(-1, len(r["bias"])), np.array(r["bias"])) for k, r in rows.items()}
    history = [r.asDict() for r in spark.read.schema(HISTORY).parquet(f"{path}/history").orderBy("epoch").collect()]
    settings = Settings(**{n: rows["last"][n] for n in asdict(Settings())})
    onward = [np.vstack([scorer[k].weights, scorer[k].bias]) for k in ("next", "first_moment", "second_moment") if k in scorer]
    return Run(history, scorer["best"], scorer["last"], rows["best"]["epoch"], rows["last"]["epoch"],
               Optimiser(*onward) if onward else None), settings


def run_rows(run: Run, constants: dict, keys: Sequence[str]) -> list[tuple]:
    """One tuple per epoch: the run's constants (``keys``), then the history columns."""
    columns = [c.split()[0] for c in HISTORY.split(", ")]
    return [tuple(constants[k] for k in keys) + tuple(r[c] for c in columns) for r in run.history]
