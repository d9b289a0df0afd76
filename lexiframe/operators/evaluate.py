"""Evaluation operators.

Everything row-sized is aggregated with map-side combine; the confusion
matrix has at most K*K rows and the classification report is computed from it
with small joins, so the driver never sees per-row data.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import argmax, cross_entropy


def label_distribution(df: DataFrame, label: str = "Sentiment",
                       extra: Sequence[Column] = ()) -> DataFrame:
    """A1 / A2: rows per label value (``value_counts`` / ``Counter``)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), *extra)


def predict(df: DataFrame, logits: str, target: str | None = None) -> DataFrame:
    """A3 + A6 + F3: predicted class, per-row cross-entropy and correctness."""
    out = df.withColumn("pred", argmax(F.col(logits)))
    if target is not None:
        out = out.withColumns({
            "loss": cross_entropy(F.col(logits), F.col(target)),
            "is_correct": F.col("pred") == F.col(target),
        })
    return out


def accuracy(df: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """A4: share of rows with prediction == target."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum((F.col(pred) == F.col(target)).cast("long")).alias("n_correct"),
                  F.avg((F.col(pred) == F.col(target)).cast("double")).alias("accuracy"))


def batch_mean_metrics(df: DataFrame, batch: str = "batch_id", correct: str = "is_correct",
                       loss: str = "loss", group: Sequence[str] = ()) -> DataFrame:
    """A5: the epoch figure as the unweighted mean of per-batch means, next to
    the row-weighted figure (they differ when the last batch is short)."""
    per_batch = df.groupBy(*group, batch).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.col(correct).cast("double")).alias("_acc"),
        F.avg(loss).alias("_loss"),
        F.sum(F.col(correct).cast("double")).alias("_c"),
        F.sum(loss).alias("_l"))
    return per_batch.groupBy(*group).agg(
        F.sum("_n").cast("long").alias("n_rows"),
        F.count(F.lit(1)).cast("long").alias("n_batches"),
        (F.sum("_c") / F.sum("_n")).alias("accuracy"),
        F.avg("_acc").alias("mean_batch_accuracy"),
        (F.sum("_l") / F.sum("_n")).alias("loss"),
        F.avg("_loss").alias("mean_batch_loss"))


def confusion(df: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """(target, pred, n) for every observed pair."""
    return df.groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(conf: DataFrame, names: Mapping[int, str] | None = None,
                          orientation: str = "standard") -> DataFrame:
    """A8 + P15: precision, recall, F1 and support per class, accuracy, macro
    and weighted averages, from a confusion table ``(target, pred, n)``.

    ``orientation="reference"`` reproduces a call with predictions passed as
    the true labels: precision and recall trade places and support counts
    predictions. The ``accuracy`` row carries the accuracy in all four
    columns, as a transposed report dictionary does. 0/0 gives 0.0.
    Class names are attached by label value, never by position.
    """
    t, p = ("pred", "target") if orientation == "reference" else ("target", "pred")
    c = conf.select(F.col(t).alias("t"), F.col(p).alias("p"), F.col("n").cast("double").alias("n"))
    # every confusion cell counts once for its true label and once for its
    # predicted label: one aggregate gives support, predicted and true positives
    zero = F.lit(0.0)
    cells = c.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")))).alias("cell")).select("cell.*")
    per = cells.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                     F.sum("tp").alias("tp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per = per.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")),
        "recall": ratio(F.col("tp"), F.col("support")),
    })
    per = per.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"),
                                           F.col("precision") + F.col("recall")))
    name_map = F.create_map(*[x for k, v in (names or {}).items() for x in (F.lit(int(k)), F.lit(v))]) \
        if names else None
    cls_name = F.coalesce(name_map[F.col("label")], F.col("label").cast("string")) if names \
        else F.col("label").cast("string")
    rows = per.select(cls_name.alias("class"), "precision", "recall", "f1_score", "support")
    tot = per.agg(F.sum("support").alias("total"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    acc = ratio(F.col("tp"), F.col("total"))

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.alias("support"))

    summary = tot.select(F.inline(F.array(
        row("accuracy", acc, acc, acc, acc),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf"), F.col("total")),
        row("weighted avg", ratio(F.col("wp"), F.col("total")), ratio(F.col("wr"), F.col("total")),
            ratio(F.col("wf"), F.col("total")), F.col("total")),
    )))
    return rows.unionByName(summary)


def best_epoch(history: DataFrame, loss: str = "valid_loss", acc: str = "valid_acc",
               epoch: str = "epoch", group: Sequence[str] = ()) -> DataFrame:
    """First epoch with the strictly lowest loss, its accuracy, and the last epoch's figures."""
    return history.groupBy(*group).agg(
        F.min_by(F.struct(F.col(epoch).alias("e"), F.col(loss).alias("l"), F.col(acc).alias("a")),
                 F.struct(F.col(loss), F.col(epoch))).alias("_best"),
        F.max_by(F.struct(F.col(epoch).alias("e"), F.col(acc).alias("a")), F.col(epoch)).alias("_last"),
    ).select(*group,
             F.col("_best.e").alias("best_epoch"), F.col("_best.l").alias("best_loss"),
             F.col("_best.a").alias("best_acc"), F.col("_last.e").alias("last_epoch"),
             F.col("_last.a").alias("last_acc"))


def mark_improvements(history: DataFrame, loss: str = "valid_loss", epoch: str = "epoch",
                      group: Sequence[str] = (), out: str = "improved") -> DataFrame:
    """A9 running form: an epoch improves when its loss is below every earlier one."""
    w = Window.partitionBy(*group).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.min(loss).over(w)
    return history.withColumn(out, prev.isNull() | (F.col(loss) < prev))


def epoch_history(metrics: DataFrame, epoch: str = "epoch", phase: str = "phase",
                  loss: str = "loss", correct: str = "is_correct", ts: str = "ts",
                  phases: Sequence[str] = ("train", "valid"), group: Sequence[str] = ()) -> DataFrame:
    """A10: per-row metrics -> one row per epoch with loss, accuracy and
    elapsed seconds (last minus first timestamp) per phase."""
    per = metrics.groupBy(*group, epoch, phase).agg(
        F.avg(loss).alias("loss"), F.avg(F.col(correct).cast("double")).alias("acc"),
        elapsed_seconds(F.min(ts), F.max(ts)).alias("secs"))
    wide = per.groupBy(*group, epoch).pivot(phase, list(phases)).agg(
        F.first("loss").alias("loss"), F.first("acc").alias("acc"), F.first("secs").alias("secs"))
    return wide


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two timestamps (microsecond precision, no time-zone conversion)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e) / 1e6


def class_weights(df: DataFrame, label: str = "Sentiment") -> DataFrame:
    """Inverse-frequency weight per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", 1.0 / F.col("n"))


def rank_runs(results: DataFrame, within: Sequence[str] = ("dataset", "classes"),
              metric: str = "test_acc", tie: str = "model", out: str = "rank") -> DataFrame:
    """Rank runs by a metric within (dataset, class variant); ties by model name."""
    w = Window.partitionBy(*within).orderBy(F.desc(metric), F.asc(tie))
    return results.withColumn(out, F.row_number().over(w).cast("int"))
