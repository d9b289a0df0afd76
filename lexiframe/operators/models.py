"""Scoring and classifiers (M1-M7) on pyspark.ml and Arrow batches.

The neural encoders of the original study are not rebuilt; their roles are
re-aimed: a pluggable scorer maps feature arrays to logits in Arrow batches
(M1), stored document vectors train a pyspark.ml classifier (M2), and a text
pipeline trains on cleaned text (M3). Evaluation reuses A3-A8.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import cross_entropy


class LinearScorer:
    """logits = X @ W + b. Small enough to ship to every task once (broadcast)."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray | None = None):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.bias = np.zeros(self.weights.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)

    @property
    def n_outputs(self) -> int:
        return self.weights.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    @classmethod
    def cosine(cls, dim_in: int, k: int) -> "LinearScorer":
        """Fixed dense scorer: weight of dimension i for output j is cos(i j), counted from 1."""
        return cls(np.cos(np.outer(np.arange(1, dim_in + 1), np.arange(1, k + 1))))


def _feature_matrix(col) -> "np.ndarray":
    """Arrow list column -> 2-D float64 matrix. Equal-length, null-free rows are
    read straight from the flat values buffer (no per-row Python); other
    batches fall back to stacking row by row."""
    import pyarrow as pa
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    lens = np.diff(col.offsets.to_numpy()) if n else np.zeros(0, dtype=np.int64)
    if col.null_count == 0 and n and (lens == lens[0]).all():
        start = col.offsets[0].as_py()
        values = col.values.slice(start, int(lens.sum())).to_numpy(zero_copy_only=False)
        return values.astype(np.float64, copy=False).reshape(n, int(lens[0]))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col.to_pylist()])


class ModularScorer:
    """Fixed scorer over padded ids and their mask: logit j is a tenth of the mean over the masked-in ids of
    ((id + j + 1) (2 j + 1)) mod 101, 0 without ids."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n = np.maximum(mask.sum(axis=1), 1)
        return np.stack([((ids + j + 1) * (2 * j + 1) % 101 * mask).sum(axis=1) / n / 10 for j in range(self.k)], axis=1)


def _scored_schema(df: DataFrame, cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in cols]
                        + [T.StructField("logits", T.ArrayType(T.DoubleType())), T.StructField("pred", T.IntegerType()),
                           T.StructField("loss", T.DoubleType())])


def _scored(columns: list, names: list[str], ok: np.ndarray, z_ok: np.ndarray | None, target) -> "pa.RecordBatch":
    """A batch of key columns with logits, prediction and loss; rows that are not ``ok`` and targets outside the logits get nulls."""
    import pyarrow as pa
    n = len(ok)
    if z_ok is None:
        nulls = [pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64())]
        return pa.RecordBatch.from_arrays(columns + nulls, names=names + ["logits", "pred", "loss"])
    k = z_ok.shape[1]
    z = np.zeros((n, k))
    z[ok] = z_ok
    loss, has_loss = np.zeros(n), np.zeros(n, bool)
    if target is not None:
        t = target.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        has_loss = ok & (t >= 0) & (t < k)
        m = z.max(axis=1)
        loss = m + np.log(np.exp(z - m[:, None]).sum(axis=1)) - z[np.arange(n), np.clip(t, 0, k - 1)]
    logits = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(z.reshape(-1)), mask=pa.array(~ok))
    return pa.RecordBatch.from_arrays(
        columns + [logits, pa.array(z.argmax(axis=1).astype(np.int32), mask=~ok), pa.array(loss, mask=~has_loss)],
        names=names + ["logits", "pred", "loss"])


def score_table(df: DataFrame, features: str, keys: Sequence[str], scorer,
                target: str | None = None) -> DataFrame:
    """M1: score every row with a plug-in scorer; prediction, loss and correctness per row.

    Runs as ``mapInArrow`` over Arrow record batches (at most
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows): the feature matrix
    is taken from the batch's flat value buffer, the scorer (broadcast once) is
    called once per batch, vectorised with numpy, and the key columns pass
    through as Arrow arrays untouched.
    """
    import pyarrow as pa
    bc = df.sparkSession.sparkContext.broadcast(scorer)
    cols = list(keys) + ([target] if target else [])

    def run(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            fcol = rb.column(features)
            ok = ~fcol.is_null().to_numpy(zero_copy_only=False)  # null vectors score to nulls
            z_ok = None
            if ok.any():
                z_ok = np.asarray(bc.value(_feature_matrix(fcol if ok.all() else fcol.filter(pa.array(ok)))), dtype=np.float64)
            yield _scored([rb.column(c) for c in cols], cols, ok, z_ok, rb.column(target) if target else None)

    return df.select(*cols, features).mapInArrow(run, _scored_schema(df, cols))


def _micro_batches(lengths: np.ndarray, cells: int):
    """Row numbers by rising length, in runs whose padded matrix has at most ``cells`` cells (a longer row alone)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        widths = np.maximum(lengths[order[at:]], 1)
        fits = int(np.searchsorted(widths * np.arange(1, len(widths) + 1), cells, side="right"))
        yield order[at:at + max(fits, 1)]
        at += max(fits, 1)


def score_encoded(df: DataFrame, keys: Sequence[str], scorer, ids: str = "input_ids", target: str | None = None,
                  pad: int = 0, cells: int = 1 << 20, labels: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """M1 over encoded rows (E2 without E7): a plug-in scorer called with padded ids and their attention mask.

    ``scorer(ids, mask)`` gets two int64 matrices (rows x longest row) and returns logits (rows x classes). Within a
    task, the rows of an Arrow batch are grouped by length into micro-batches padded to their own longest row, bounded
    in cells (not rows), and put back in order: long rows do not widen short ones, and memory does not depend on
    the batch. A scorer that heeds the mask gives the same scores however rows are batched. NULL ids score to nulls, a row
    without ids is all padding; a target that is NULL or outside the logits has no loss.

    With ``labels``, a table of ``on`` (one of the keys) and ``target``, the targets are joined to the scores by ``on``
    instead of being a column of ``df``: if that join shuffles, it moves keys and logits, not ids. A row without a label has
    a NULL target, one with several has a row for each."""
    if labels is not None:
        scored = score_encoded(df, keys, scorer, ids, pad=pad, cells=cells).drop("loss")
        return scored.join(labels.select(on, target), on, "left").select(
            *keys, target, "logits", "pred", cross_entropy("logits", target).alias("loss"))
    bc = df.sparkSession.sparkContext.broadcast(scorer)
    cols = list(keys) + ([target] if target else [])
    ids_at = len(cols)

    def run(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            lists = rb.column(ids_at)
            ok = lists.is_valid().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().drop_null().to_numpy().astype(np.int64)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lengths)
            z_ok = None
            for rows in _micro_batches(lengths, cells):
                width = max(int(lengths[rows].max()), 1)
                mask = (np.arange(width) < lengths[rows][:, None])
                matrix = np.full(mask.shape, pad, np.int64)
                matrix[mask] = flat[np.concatenate([np.arange(ends[r] - lengths[r], ends[r]) for r in rows])]
                z = np.asarray(bc.value(matrix, mask.astype(np.int64)), dtype=np.float64)
                z_ok = np.zeros((len(lengths), z.shape[1])) if z_ok is None else z_ok
                z_ok[rows] = z
            yield _scored(rb.columns[:ids_at], cols, ok, z_ok, rb.column(ids_at - 1) if target else None)

    return df.select(*cols, ids).mapInArrow(run, _scored_schema(df, cols))


def train_frozen(df: DataFrame, features: str, label: str, key: str, split_col: str = "split",
                 train_value: str = "train", max_iter: int = 50, reg: float = 0.0):
    """M2: classifier on stored (frozen) vectors, fitted on the train rows.

    Rows are ordered by their unique key within partitions before fitting so
    that the optimiser sees the same data order on every run.
    """
    data = df.select(key, array_to_vector(F.col(features)).alias("features"),
                     F.col(label).cast("double").alias("label"), split_col)
    train = data.where(F.col(split_col) == train_value).sortWithinPartitions(key)
    model = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial").fit(train)
    return model, model.transform(data).withColumn("pred", F.col("prediction").cast("int"))


def text_pipeline(tokens: str = "tokens", label: str = "label",
                  num_features: int = 1 << 18, weight: str | None = "weight", max_iter: int = 30) -> Pipeline:
    """M3: token arrays -> hashed term counts -> IDF -> logistic regression
    (class weights from A11 through ``weightCol``). The tokens are the engine's own
    (``functions.text.tokenize``): no case folding, no empty token for doubled spaces."""
    lr = LogisticRegression(labelCol=label, maxIter=max_iter)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="features"), lr])


def save_model(model: PipelineModel, path: str) -> None:
    """M6: persist a fitted pipeline (:mod:`lexiframe.operators.training` saves models with their history)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def pooled_vectors(df: DataFrame, vec: str, group: Sequence[str], dim: int) -> DataFrame:
    """M4 + M5: per group the per-dimension max (and mean), concatenated, and its tanh.

    One aggregate with ``dim`` max/avg expressions (map-side combined); rows
    are never exploded and no vectors are collected. A vector shorter than
    ``dim`` adds nothing to the dimensions it lacks.
    """
    v = F.col(vec)
    aggs = ([F.max(F.get(v, F.lit(i)).cast("double")).alias(f"_mx{i}") for i in range(dim)]
            + [F.avg(F.get(v, F.lit(i)).cast("double")).alias(f"_mn{i}") for i in range(dim)])
    g = df.groupBy(*group).agg(*aggs)
    mx = F.array(*[F.col(f"_mx{i}") for i in range(dim)])
    mn = F.array(*[F.col(f"_mn{i}") for i in range(dim)])
    return g.select(*group, mx.alias("max_pool"), F.concat(mx, mn).alias("features")).withColumn(
        "tanh", F.transform("features", lambda x: F.tanh(x)))
