"""Quality classifier: regularised quadratic discriminant.

Every text becomes a vector of transformed document statistics. Each class has
a Gaussian whose covariance is shrunk twice: towards the pooled covariance
(``pool``) and towards its own diagonal (``diagonal``). The score of a text is
the posterior of label 1: the difference of the two Mahalanobis log densities,
computed with the Cholesky factors kept in the model.

Texts are read once: the statistics table is narrow (17 doubles a row), class
counts, means and covariances are sums over all labelled rows made by Spark
(one partial moment vector per task, added up by position), and only the two
fixed-size moment vectors reach the driver.

Defined results: a null text counts as empty, and an empty text has a score
like any other; a null or repeated ``doc_id`` keeps its rows; a label row with a
null ``doc_id`` or null label is ignored; several labels of one document count
as their rounded mean; with only one class labelled every score is that label,
with no label at all 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import materialize
from .common import strings, text_batches, utf8

THRESHOLD = 0.3
# byte classes of the statistics
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, COMMA, SHOUT, BAR, PUNCT, SYMBOL, LEAD, CONT = range(13)
N_CLASSES = 13
SHARES = (UPPER, DIGIT, NEWLINE, STOP, COMMA, SHOUT, BAR, PUNCT, SYMBOL)
N_FEATURES = len(SHARES) + 8


def _byte_classes() -> np.ndarray:
    lut = np.full(256, SYMBOL, np.int64)
    lut[0x80:0xC0] = CONT
    lut[0xC0:] = LEAD
    for cls, chars in ((LOWER, bytes(range(97, 123))), (UPPER, bytes(range(65, 91))), (DIGIT, b"0123456789"),
                       (SPACE, b" \t\r\x0b\x0c"), (NEWLINE, b"\n"), (STOP, b"."), (COMMA, b","), (SHOUT, b"!?"),
                       (BAR, b"|"), (PUNCT, b"'\"-:;()")):
        lut[list(chars)] = cls
    return lut


_LUT = _byte_classes()


def text_statistics(column: pa.Array) -> np.ndarray:
    """(rows, N_FEATURES) transformed statistics of a batch of whole texts."""
    raw, off = utf8(column)
    n = len(off) - 1
    lens = np.diff(off)
    counts = np.zeros((n, N_CLASSES))
    for a in range(0, n, 64):  # bounds the index arrays for long texts
        b = min(n, a + 64)
        rows = np.repeat(np.arange(b - a) * N_CLASSES, lens[a:b])
        counts[a:b] = np.bincount(rows + _LUT[raw[off[a]:off[b]]], minlength=(b - a) * N_CLASSES).reshape(b - a, N_CLASSES)
    words = np.zeros((n, 5))
    for i, text in enumerate(strings(column)):
        w = text.split()
        lines = [x for x in text.split("\n") if x]
        again = sum(map(str.__eq__, w[1:], w))
        distinct = set(w)
        words[i] = (len(w), len(distinct), again, len(lines) - len(set(lines)), len(lines))
    chars = lens - counts[:, CONT]
    nw, nd, again, line_dups, n_lines = words.T
    solid = chars - counts[:, SPACE] - counts[:, NEWLINE]
    x = [np.log1p(chars), np.log1p(nw), np.log1p(solid / np.maximum(nw, 1)),
         np.log1p(nd) / np.maximum(np.log1p(nw), 1e-9),
         np.log(again / np.maximum(nw, 1) + 0.002),
         np.log(line_dups / np.maximum(n_lines, 1) + 0.01),
         np.log(1 - nd / np.maximum(nw, 1) + 0.01),
         np.log(np.maximum(n_lines, 1) / np.maximum(nw, 1))]
    x += [np.log(counts[:, c] / np.maximum(chars, 1) + 0.001) for c in SHARES]
    return np.stack(x, axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, lower Cholesky factor and half its log determinant."""
    log_prior: np.ndarray
    mean: np.ndarray
    chol: np.ndarray
    half_logdet: np.ndarray
    constant: float | None = None  # the score when a class has no rows

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = []
        for k in (0, 1):
            z = np.linalg.solve(self.chol[k], (x - self.mean[k]).T)
            log_density.append(self.log_prior[k] - self.half_logdet[k] - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def discriminant(moments: dict[int, np.ndarray], pool: float, diagonal: float) -> Discriminant:
    """Model from each class's (count, sums, sums of products)."""
    d = N_FEATURES
    present = [k for k in (0, 1) if k in moments and moments[k][0] > 0]
    if len(present) < 2:
        return Discriminant(*(np.zeros(0),) * 4, constant=float(present[0]) if present else 0.5)
    n = np.array([moments[k][0] for k in (0, 1)])
    mean = np.array([moments[k][1:1 + d] / moments[k][0] for k in (0, 1)])
    scatter = [moments[k][1 + d:].reshape(d, d) - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(n.sum() - 2, 1)
    floor = 1e-6 + 1e-3 * np.diag(pooled)
    chol, half = [], []
    for k in (0, 1):
        weight = min(1.0, pool + d / n[k])  # few rows lean more on the pooled covariance
        cov = (1 - weight) * scatter[k] / max(n[k] - 1, 1) + weight * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + np.diag(floor)
        chol.append(np.linalg.cholesky(cov))
        half.append(np.log(np.diag(chol[-1])).sum())
    return Discriminant(np.log(n / n.sum()), mean, np.array(chol), np.array(half))


def statistics(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep`` columns of ``docs`` and ``x``, the statistics of each whole ``text``."""
    text_batches(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def stats(text: pa.Array) -> pa.Array:
        x = text_statistics(text)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.reshape(-1)))

    return docs.select(*keep, stats(F.col("text")).alias("x"))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", holdout: Column | None = None,
        pool: float = 0.1, diagonal: float = 0.05) -> Discriminant:
    """Fit on every row of ``stats`` (doc_id, x) that ``labels`` marks 0 or 1, except ``holdout`` rows."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y")))
    train = stats.select("doc_id", "x")
    if holdout is not None:
        train = train.where(~holdout)
    d = N_FEATURES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            y = b.column(0).to_numpy()
            for k in (0, 1):
                v = x[y == k]
                sums[k] += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).reshape(-1)])
        for k in (0, 1):
            yield pa.RecordBatch.from_pydict({"y": pa.array([k], pa.int32()), "m": pa.array([sums[k]], pa.list_(pa.float64()))})

    parts = train.join(marks, "doc_id").select("y", "x").mapInArrow(partial, "y int, m array<double>")
    total = (parts.select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
             .collect())  # 2 classes x (1 + d + d^2) sums, whatever the input
    moments: dict[int, np.ndarray] = {}
    for r in total:
        moments.setdefault(r["y"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return discriminant(moments, pool, diagonal)


def score_statistics(model: Discriminant) -> Column:
    """Score of the statistics column ``x``."""
    @F.arrow_udf(DoubleType())
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy().reshape(-1, N_FEATURES)))

    return score(F.col("x"))


def score_text(model: Discriminant) -> Column:
    """Score of the whole text in column ``text``."""
    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text_statistics(text)))

    return score(F.col("text"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32(doc_id as text) mod 5 is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = materialize(statistics(docs, "doc_id"), "quality-stats")
    model = fit(stats, labels, holdout=held_out())
    return (stats.select("doc_id", held_out().alias("held_out"), score_statistics(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the classifier accepts (score >= threshold)."""
    stats = materialize(statistics(docs, "doc_id"), "quality-stats")
    model = fit(stats, labels, holdout=held_out())
    return docs.where(score_text(model) >= threshold)
