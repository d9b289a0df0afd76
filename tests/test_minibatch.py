"""Mini-batch training against a plain loop over the same batches, orders and shards."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import evaluate as A
from lexiframe.operators.minibatch import deal_batches, epoch_means, fit_batches
from lexiframe.operators.training import Head, Settings

HEAD = Head("label", 3, 6, Settings(3, 0.05, 0.01), "weight")
SIZE, SEED, SHARDS = 16, 77, 4


def md5(seed, k):
    return hashlib.md5(f"{seed}:{k}".encode()).hexdigest()


def rows(n=300):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 6))
    phases = ["train"] * 7 + ["valid"] * 2 + ["test"]
    return [(i, [float(v) for v in centres[i % 3] + rng.normal(size=6)], i % 3, 1.0 + (i % 2), phases[i % 10], "extra") for i in range(n)]


SCHEMA = "id long, features array<double>, label int, weight double, phase string, rows string"


def figures(w, xs, ys, ws):
    z = xs @ w[:-1] + w[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(ys))
    loss = float((ws * -np.log(p[at, ys])).sum() / ws.sum())
    acc = float((z.argmax(axis=1) == ys).mean())
    p[at, ys] -= 1
    p *= ws[:, None]
    return loss, acc, np.vstack([xs.T @ p, p.sum(axis=0)]) / ws.sum()


def plain(data):
    """Epochs of local Adam steps, one shard after the other; {(epoch, phase, batch): (rows, loss, accuracy)}."""
    batches = {}
    for phase in ("train", "valid", "test"):
        ids = sorted((r for r in data if r[4] == phase), key=lambda r: (md5(SEED, r[0]), r[0]))
        for i in range(0, len(ids), SIZE):
            part = sorted(ids[i:i + SIZE])
            batches[phase, i // SIZE] = tuple(np.array([r[c] for r in part]) for c in (1, 2, 3))
    out, w, best = {}, np.zeros((7, 3)), (np.inf, 0, None)
    for epoch in (1, 2, 3):
        train = sorted((b for p, b in batches if p == "train"), key=lambda b: md5(SEED + epoch, b))
        total = np.zeros_like(w)
        for shard in range(SHARDS):
            v, m1, m2, step = w, 0.0, 0.0, 0
            for b in train:
                if int(md5(SEED + epoch, b)[:8], 16) % SHARDS != shard:
                    continue
                x, y, s = batches["train", b]
                loss, acc, g = figures(v, x, y, s)
                out[epoch, "train", b] = len(y), loss, acc
                g[:-1] += 0.01 * v[:-1]
                step += 1
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
                v = v - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            total += v * sum(len(batches["train", b][1]) for b in train if int(md5(SEED + epoch, b)[:8], 16) % SHARDS == shard)
        w = total / sum(len(batches["train", b][1]) for b in train)
        valid = {b: figures(w, *batches["valid", b]) for p, b in batches if p == "valid"}
        out |= {(epoch, "valid", b): (len(batches["valid", b][1]), f[0], f[1]) for b, f in valid.items()}
        mean = np.mean([f[0] for f in valid.values()])
        if mean < best[0]:
            best = mean, epoch, w
    out |= {(best[1], "test", b): (len(batches[p, b][1]), *figures(best[2], *batches[p, b])[:2]) for p, b in batches if p == "test"}
    return out, best, w


def trained(spark, data, head=HEAD, parts=5):
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    return fit_batches(deal_batches(df, "id", head, SIZE, SEED), head, SHARDS, SEED)


def test_equals_a_plain_loop(spark):
    data = rows()
    run = trained(spark, data)
    want, best, last = plain(data)
    got = {(r["epoch"], r["phase"], r["batch_id"]): (r["n_rows"], r["loss"], r["accuracy"]) for r in run.metrics.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-9), k
    assert run.best_epoch == best[1]
    assert np.allclose(run.best.weights, best[2][:-1], atol=1e-9) and np.allclose(run.last.bias, last[-1], atol=1e-9)
    # every epoch sees each train batch once
    assert all(sorted(b for e, p, b in got if (e, p) == (epoch, "train")) == list(range(14)) for epoch in (1, 2, 3))


def test_partitions_and_reruns_give_the_same_bits(spark):
    data = rows(200)
    one, two = trained(spark, data, parts=1), trained(spark, data[::-1], parts=7)
    assert sorted(one.metrics.collect()) == sorted(two.metrics.collect())
    assert np.array_equal(one.last.weights, two.last.weights) and np.array_equal(one.best.bias, two.best.bias)


def test_epoch_means_equal_those_over_rows(spark):
    run = trained(spark, rows(200))
    means = {(r["epoch"], r["phase"]): r for r in epoch_means(run.metrics).collect()}
    assert means[1, "train"]["n_batches"] == 9 and means[1, "train"]["n_rows"] == 140
    # A5 over single examples that carry their batch's figures
    each = run.metrics.select("epoch", "phase", "batch_id", "loss", "accuracy", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("i"))
    for r in A.batch_mean_metrics(each, "batch_id", "accuracy", "loss", ("epoch", "phase")).collect():
        m = means[r["epoch"], r["phase"]]
        assert (m["n_batches"], m["n_rows"]) == (r["n_batches"], r["n_rows"])
        assert m["mean_batch_loss"] == pytest.approx(r["mean_batch_loss"], abs=1e-12)
        assert m["mean_batch_accuracy"] == pytest.approx(r["mean_batch_accuracy"], abs=1e-12)


def test_unfit_examples_take_no_part(spark):
    good = rows(120)
    bad = [(900, None, 1, 1.0, "train", "x"), (901, [1.0] * 5, 1, 1.0, "train", "x"), (902, [1.0] * 6, 3, 1.0, "train", "x"),
           (903, [1.0] * 6, None, 1.0, "train", "x"), (904, [1.0] * 5 + [None], 1, 1.0, "train", "x"),
           (905, [float("nan")] * 6, 1, 1.0, "train", "x"), (906, [1.0] * 6, 1, None, "train", "x"),
           (907, [1.0] * 6, 1, 1.0, None, "x"), (908, [1.0] * 6, 1, 1.0, "other", "x"), (None, [1.0] * 6, 1, 1.0, "train", "x")]
    assert sorted(trained(spark, good).metrics.collect()) == sorted(trained(spark, good + bad).metrics.collect())


def test_no_rows_no_train_rows_and_hashes(spark):
    none = trained(spark, [])
    assert none.metrics.collect() == [] and not none.last.weights.any()
    only = trained(spark, [r for r in rows(100) if r[4] == "valid"])
    losses = [r["loss"] for r in only.metrics.collect()]
    assert not only.last.weights.any() and losses == pytest.approx([np.log(3)] * len(losses))
    data = [(i, [i % 2, 5 + i % 2] * 3, i % 2, "train" if i % 4 else "valid") for i in range(160)]
    df = spark.createDataFrame(data, "id long, hashes array<long>, label int, phase string")
    head = Head("label", 2, 4, Settings(4, 0.1))
    run = fit_batches(deal_batches(df, "id", head, 8), head, 2)
    last = [r["accuracy"] for r in run.metrics.where("epoch = 4 AND phase = 'valid'").collect()]
    assert last and min(last) == 1.0
