import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from lexiframe.llm import quality as Q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(truth[i], r) for i, r in rows.items() if i in truth and r["held_out"]]
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())
    assert sum(y == r["predicted"] for y, r in held) / len(held) > 0.95
    good, bad = ([r["score"] for y, r in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, text string")


def test_labels_of_held_out_rows_change_nothing(spark, documents, real):
    df = documents(real)
    some = [(i, k % 2, "") for k, (i, _, _) in enumerate(real)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, "") for i, q, _ in some]
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in Q.classify(df, labelled(spark, x)).collect()) for x in (some, flipped))
    assert a == b


def test_one_class_or_no_labels(spark, documents):
    df = documents([(1, "a"), (2, None), (None, "b")])
    only = [(i, 1, "") for i in range(1, 40)]
    assert {r["score"] for r in Q.classify(df, labelled(spark, only)).collect()} <= {1.0}
    assert {r["score"] for r in Q.classify(df, labelled(spark, [(None, 1, ""), (1, None, "")])).collect()} == {0.5}
    assert Q.classify(documents([]), labelled(spark, only)).collect() == []


def test_odd_texts_and_repeated_labels(spark, documents, real):
    df = documents(real + [(None, None), (10**6, ""), (10**6, ""), (10**6 + 1, "x" * 300_000), (10**6 + 2, "\x00퟿" * 10)])
    marks = [(i, int(k % 3 > 0), "") for k, (i, _, _) in enumerate(real)] * 2 + [(10**6, 1, "")]
    out = Q.classify(df, labelled(spark, marks)).collect()
    assert len(out) == len(real) + 5 and all(0 <= r["score"] <= 1 for r in out)
    kept = Q.keep_good(df, labelled(spark, marks))
    assert kept.columns == df.columns
    assert kept.count() == sum(r["predicted"] for r in out)


def test_density_difference_matches_direct_formula():
    rng = np.random.default_rng(1)
    d = Q.N_FEATURES
    x = {k: rng.normal(k, 1 + k, (400, d)) @ rng.normal(0, 1, (d, d)) for k in (0, 1)}
    m = {k: np.concatenate([[len(v)], v.sum(0), (v.T @ v).reshape(-1)]) for k, v in x.items()}
    model = Q.discriminant(m, 0.1, 0.05)
    probe = x[1][:5]
    logs = []
    for k in (0, 1):
        cov = model.chol[k] @ model.chol[k].T
        diff = probe - model.mean[k]
        logs.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_do_not_depend_on_the_batch(documents, real):
    df = documents(real[:40] + [(9999, None)])
    a = {r["doc_id"]: r["x"] for r in Q.statistics(df, "doc_id").collect()}
    b = {r["doc_id"]: r["x"] for r in Q.statistics(df.repartition(13), "doc_id").collect()}
    assert a == b and all(len(v) == Q.N_FEATURES for v in a.values())
