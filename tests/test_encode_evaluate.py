"""Encoding round trips, masks, reports against brute force."""
import pytest
from pyspark.sql import functions as F

from lexiframe.functions.text import tokenize
from lexiframe.operators import encode as E
from lexiframe.operators import evaluate as A


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["a b c a", "b b d", "", "e " * 10, "a z"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn(
        "tokens", tokenize("text"))


def test_encode_decode_identity_and_mask(spark, corpus):
    vocab = E.build_vocab(corpus, "tokens", 3)  # e, then a and b tied (ties by token)
    got = {r["token"]: r["id"] for r in vocab.collect()}
    assert got == {"e": 4, "a": 5, "b": 6}
    enc = E.encode(corpus, "doc_id", "tokens", vocab, 8)
    rows = {r["doc_id"]: r for r in enc.collect()}
    assert rows[0]["input_ids"] == [2, 5, 6, 1, 5, 3, 0, 0]
    assert rows[2]["input_ids"] == [2, 3, 0, 0, 0, 0, 0, 0]
    assert rows[3]["input_ids"] == [2, 4, 4, 4, 4, 4, 4, 3]  # truncated to L-2 then specials
    for r in rows.values():
        assert sum(r["attention_mask"]) == r["n_tokens"] and len(r["input_ids"]) == 8
    dec = {r["doc_id"]: r["tokens"] for r in E.decode(enc, "doc_id", "input_ids", vocab).collect()}
    assert dec[0] == ["<s>", "a", "b", "<unk>", "a", "</s>"]
    assert dec[4] == ["<s>", "a", "<unk>", "</s>"]


def test_label_index_frequency_then_label(spark):
    df = spark.createDataFrame([(x,) for x in "ccbbbaa"], "label string")
    got = {r["label"]: r["idx"] for r in E.label_index(df, "label").collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def _brute_report(t, p):
    labels = sorted(set(t) | set(p))
    out = {}
    for c in labels:
        tp = sum(1 for a, b in zip(t, p) if a == c and b == c)
        pred = sum(1 for b in p if b == c)
        sup = sum(1 for a in t if a == c)
        pr = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        out[str(c)] = (pr, rc, f1, float(sup))
    acc = sum(1 for a, b in zip(t, p) if a == b) / len(t)
    out["accuracy"] = (acc,) * 4
    n = len(t)
    out["macro avg"] = tuple(sum(v[i] for k, v in out.items() if k not in ("accuracy",)) / len(labels)
                             for i in range(3)) + (float(n),)
    out["weighted avg"] = tuple(sum(out[str(c)][i] * out[str(c)][3] for c in labels) / n for i in range(3)) + (float(n),)
    return out


@pytest.mark.parametrize("orientation", ["standard", "reference"])
def test_report_against_brute_force(spark, orientation):
    t = [0, 0, 1, 1, 1, 2, 2, 0, 1, 2, 2, 2]
    p = [0, 1, 1, 1, 3, 2, 0, 0, 1, 1, 2, 2]  # 3 is an extra output never seen as a target
    df = spark.createDataFrame(list(zip(t, p)), "target int, pred int")
    rep = {r["class"]: (r["precision"], r["recall"], r["f1_score"], r["support"])
           for r in A.classification_report(A.confusion(df), orientation=orientation).collect()}
    want = _brute_report(t, p) if orientation == "standard" else _brute_report(p, t)
    assert rep.keys() == want.keys()
    for k in want:
        assert rep[k] == pytest.approx(want[k], abs=1e-12)
    if orientation == "standard":
        assert rep["weighted avg"][1] == pytest.approx(rep["accuracy"][0])


def test_best_epoch_first_minimum(spark):
    h = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.3, 0.2), (3, 0.3, 0.3), (4, 0.4, 0.4)],
                              "epoch int, valid_loss double, valid_acc double")
    r = A.best_epoch(h).first()
    assert (r["best_epoch"], r["best_acc"], r["last_epoch"], r["last_acc"]) == (2, 0.2, 4, 0.4)
    marks = [r["improved"] for r in A.mark_improvements(h).orderBy("epoch").collect()]
    assert marks == [True, True, False, False]


def test_batch_means_differ_from_row_mean(spark):
    df = spark.createDataFrame([(0, True, 1.0), (0, True, 1.0), (1, False, 4.0)],
                               "batch_id long, is_correct boolean, loss double")
    r = A.batch_mean_metrics(df).first()
    assert r["accuracy"] == pytest.approx(2 / 3) and r["mean_batch_accuracy"] == pytest.approx(0.5)
    assert r["loss"] == pytest.approx(2.0) and r["mean_batch_loss"] == pytest.approx(2.5)


def test_pooled_vectors_of_ragged_rows_with_tanh(spark):
    import math

    from lexiframe.operators.models import pooled_vectors
    df = spark.createDataFrame([(0, [1.0, -2.0]), (0, [3.0, -1.0]), (0, [0.5]), (1, [0.5, 0.5]), (2, None)], "doc int, v array<double>")
    got = {r["doc"]: r for r in pooled_vectors(df, "v", ["doc"], 2).collect()}
    assert got[0]["features"] == [3.0, -1.0, 1.5, -1.5] and got[1]["features"] == [0.5] * 4
    assert got[0]["max_pool"] == [3.0, -1.0] and got[0]["tanh"] == pytest.approx([math.tanh(x) for x in (3.0, -1.0, 1.5, -1.5)])
    assert got[2]["features"] == [None] * 4


def test_scorer_matches_sql_expressions(spark):
    import numpy as np
    from lexiframe.functions.scoring import argmax, cross_entropy
    from lexiframe.operators.models import LinearScorer, score_table
    rng = np.random.default_rng(0)
    targets = [-2, -1, 0, 1, 2, 3]  # outside 0..2 there is no loss in either form
    rows = [(i, targets[i % 6], [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, target int, v array<double>")
    s = score_table(df, "v", ["k"], LinearScorer(np.eye(3)), target="target")
    ref = df.select("k", argmax("v").alias("p"), cross_entropy("v", "target").alias("l"))
    a = {r["k"]: (r["pred"], r["loss"]) for r in s.collect()}
    b = {r["k"]: (r["p"], r["l"]) for r in ref.collect()}
    for k in a:
        assert a[k][0] == b[k][0]
        if 0 <= targets[k % 6] < 3:
            assert a[k][1] == pytest.approx(b[k][1], rel=1e-12)
        else:
            assert a[k][1] is None and b[k][1] is None


def test_repeated_key_rows_are_encoded_separately(spark):
    df = spark.createDataFrame([(7, "a b"), (7, "c"), (8, "")], "doc_id long, text string").withColumn(
        "tokens", tokenize("text"))
    vocab = E.build_vocab(df, "tokens", 10)
    enc = E.encode(df, "doc_id", "tokens", vocab, 6)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in enc.collect())
    assert got == [(7, 3), (7, 4), (8, 2)]


def test_stop_table_keeps_null_and_order(spark):
    from lexiframe.operators.shape import remove_stop_words_table
    df = spark.createDataFrame([(1, "x the y the x"), (2, None), (3, "the")], "k long, t string")
    stop = spark.createDataFrame([("the",)], "word string")
    got = {r["k"]: r["o"] for r in remove_stop_words_table(df, "k", "t", stop, out="o").collect()}
    assert got == {1: "x y x", 2: None, 3: ""}


def test_confusion_total_equals_rows(spark):
    from conftest import SF01
    import __spark_entry__ as se
    conf = se.queries()["confusion"](spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    assert conf.agg(F.sum("n")).first()[0] == labels.count()


def test_encoded_length_equals_encoded_size(spark):
    from lexiframe.operators import encode as E
    rows = [(1, ["a", "b", "zz"]), (2, []), (3, None),  # NULL tokens have NULL ids and no length
             (4, ["a"] * 20), (5, ["b", "q", "a", "a", "b", "c", "d", "e"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    vocab = E.build_vocab(df, "tokens", 3)
    enc = E.encode(df, "k", "tokens", vocab, 6, pad=False)
    want = {r["k"]: r["n_tokens"] for r in enc.collect()}
    got = {r["k"]: r["n"] for r in df.select("k", E.encoded_length("tokens", 6).alias("n")).collect()}
    assert got == want


def test_hot_key_and_hot_token_against_brute_force(spark):
    # one key holds a third of the rows (with several exact copies) and one token
    # a third of all occurrences: every row is still encoded and stop-filtered on
    # its own, with the same result as a per-row Python computation
    import random
    from lexiframe.operators.shape import remove_stop_words_table
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(900):
        k = 0 if i % 3 == 0 else i
        toks = [("hot" if rnd.random() < 0.34 else rnd.choice(words)) for _ in range(rnd.randint(0, 12))]
        rows.append((k, " ".join(toks)))
    rows += [(0, "hot w1 hot")] * 30  # exact copies under the hot key
    df = spark.createDataFrame(rows, "k long, t string").repartition(5, "k").withColumn("tokens", tokenize("t"))
    vocab = E.build_vocab(df, "tokens", 25)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    enc = E.encode(df, "k", "tokens", vocab, 8, pad=False)
    got = sorted((r["k"], tuple(r["input_ids"])) for r in enc.collect())
    want = sorted((k, tuple([2] + [ids.get(w, 1) for w in t.split()][:6] + [3])) for k, t in rows)
    assert got == want
    stop = spark.createDataFrame([("hot",), ("w3",)], "word string")
    kept = remove_stop_words_table(df, "k", "t", stop, out="o", spaces_only=True)
    got = sorted((r["k"], r["o"]) for r in kept.collect())
    want = sorted((k, " ".join(w for w in t.split() if w not in ("hot", "w3"))) for k, t in rows)
    assert got == want


def test_scorer_nulls_and_ragged_batches(spark):
    import numpy as np
    from lexiframe.operators.models import LinearScorer, score_table
    rows = [(1, [1.0, 5.0, 2.0], 1), (2, None, 0), (3, [3.0, 1.0, 0.0], None), (4, [0.0, 0.0, 9.0], 2)]
    df = spark.createDataFrame(rows, "k long, v array<double>, target int")
    got = {r["k"]: r for r in score_table(df, "v", ["k"], LinearScorer(np.eye(3)), target="target").collect()}
    assert got[1]["pred"] == 1 and got[4]["pred"] == 2 and got[3]["pred"] == 0
    assert got[2]["pred"] is None and got[2]["logits"] is None and got[2]["loss"] is None
    assert got[3]["loss"] is None and got[1]["loss"] is not None
    assert got[1]["logits"] == [1.0, 5.0, 2.0]


def test_apply_label_index_with_unseen_label(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("c",), ("c",)], "label string")
    idx = E.label_index(train, "label")
    rows = spark.createDataFrame([(1, "c"), (2, "a"), (3, "zzz"), (4, "b")], "k long, label string")
    got = {r["k"]: r["idx"] for r in E.apply_label_index(rows, idx, "label").collect()}
    assert got == {1: 0, 4: 1, 2: 2, 3: 3}  # unseen label gets n_labels


@pytest.fixture
def no_small_tables(monkeypatch):
    from lexiframe.operators import lookup
    monkeypatch.setattr(lookup, "BROADCAST_TOKENS", 0)


def test_stop_table_shuffle_path_equals_inline_list(spark, no_small_tables):
    from lexiframe.functions.text import remove_stop_words
    from lexiframe.operators.shape import remove_stop_words_table
    rows = [(i, " ".join(("the", "a", "cat", "the", "dog", "x")[j % 6] for j in range(i % 9))) for i in range(60)]
    rows += [(7, "the the"), (8, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    stop = spark.createDataFrame([("the",), ("x",)], "word string")
    got = sorted(repr((r["k"], r["o"])) for r in remove_stop_words_table(df, "k", "t", stop, out="o", spaces_only=True).collect())
    want = sorted(repr((r["k"], r["o"])) for r in df.select(
        "k", remove_stop_words("t", ["the", "x"], spaces_only=True).alias("o")).collect())
    assert got == want


def test_shuffled_lookups_equal_those_in_batches(spark, monkeypatch):
    from lexiframe.operators import lookup
    rows = [(i % 50, " ".join(["hot"] * (i % 4) + [f"w{i % 13}", "hot", f"w{i % 7}"])) for i in range(300)]
    df = spark.createDataFrame(rows + [(99, None), (98, "")], "k long, t string").withColumn("tokens", tokenize("t"))
    vocab = E.build_vocab(df, "tokens", 12)

    def both():
        enc = E.encode(df, "k", "tokens", vocab, 7)
        ids = sorted((r["k"], str(r["input_ids"]), str(r["attention_mask"]), str(r["n_tokens"])) for r in enc.collect())
        dec = sorted((r["k"], str(r["tokens"])) for r in E.decode(enc, "k", "input_ids", vocab).collect())
        bare = sorted((r["k"], str(r["tokens"])) for r in E.decode(enc, "k", "input_ids", vocab, mask=None).collect())
        return ids, dec, bare

    small = both()
    assert (99, "None", "None", "None") in small[0] and (99, "None") in small[1]
    monkeypatch.setattr(lookup, "BROADCAST_TOKENS", 0)
    assert both() == small


@pytest.mark.parametrize("hot", [2, 5, 0])
def test_only_rare_tokens_are_joined_by_shuffle(spark, monkeypatch, hot):
    from lexiframe.operators import lookup
    rows = [(i % 50 if i % 9 else None, " ".join(["hot"] * (i % 4) + [f"w{i % 13}", "hot", f"w{i % 7}"])) for i in range(300)]
    df = spark.createDataFrame(rows + [(99, None), (98, "")], "k long, t string").withColumn("tokens", tokenize("t"))
    df = df.unionByName(df.where("k = 3").withColumn("tokens", F.array(F.lit("w1"), F.lit(None).cast("string"), F.lit("hot"))))
    vocab = E.build_vocab(df, "tokens", 12)

    def ids():
        return sorted(str((r["k"], r["input_ids"])) for r in E.encode(df, "k", "tokens", vocab, 7, pad=False).collect())

    small, written = ids(), []
    monkeypatch.setattr(lookup, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(lookup, "HOT_TOKENS", hot)
    keep = E.materialize
    monkeypatch.setattr(E, "materialize", lambda d, name: written.append(keep(d, name)) or written[-1])
    assert ids() == small
    first = written[-1].select(F.sum(F.size("_e.rare")).alias("rare"), F.sum(F.when(F.col("_e").isNotNull(), F.size("_e.ids"))).alias("all")).first()
    found = {t for r in written[-1].select("_e.rare").collect() for t in r["rare"] or []}
    known = {r["token"] for r in vocab.collect() if r["id"] < 4 + hot}
    assert len(known) == hot and not found & known and (first["rare"] < first["all"] if hot else first["rare"] > 0)


@pytest.mark.parametrize("hot", [2, 5, 0])
def test_only_rare_ids_are_joined_by_shuffle(spark, monkeypatch, hot):
    from lexiframe.operators import lookup
    vocab = spark.createDataFrame([(f"t{i}", i + 4, 100 - i) for i in range(12)], "token string, id int, count long")
    ids = [[2, 4 + i % 12, 5, None, 1, 77, 4 + i % 5, 3, 0, 0] for i in range(80)]
    rows = [(i % 7, x, [1] * 8 + [0, 0]) for i, x in enumerate(ids)] + [(None, ids[0], [1] * 10), (5, [], []), (6, None, None)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>, attention_mask array<int>").repartition(3)

    def texts(mask):
        return sorted(str((r["k"], r["tokens"])) for r in E.decode(df, "k", "input_ids", vocab, mask=mask).collect())

    small, bare = texts("attention_mask"), texts(None)
    monkeypatch.setattr(lookup, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(lookup, "HOT_TOKENS", hot)
    written, keep = [], E.materialize
    monkeypatch.setattr(E, "materialize", lambda d, name: written.append((name, keep(d, name))) or written[-1][1])
    assert texts("attention_mask") == small and texts(None) == bare
    kept = dict(written[:1])["decoded-ids"].select(F.sum(F.size("_ids"))).first()[0]
    assert kept == 8 * 80 + 10  # masked places take no part


def test_training_steps_are_bounded_in_list_entries(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from lexiframe.operators import training as R
    monkeypatch.setattr(R, "STEP_CELLS", 64)
    lengths = [0, 3, 70, 10, 30, 30, 30, 0, 0, 5] + [1] * 40
    steps = list(R._row_steps(pa.array([list(range(n)) for n in lengths]), 4))
    assert [a for a, _ in steps] == [0] + [b for _, b in steps[:-1]] and steps[-1][1] == len(lengths)
    assert all(b - a == 1 or (sum(lengths[a:b]) <= 64 and b - a <= 16) for a, b in steps)


def test_training_batches_hold_small_buckets(spark):
    import numpy as np
    from lexiframe.operators import training as R
    hashes = [-2**63, 2**63 - 1, -1, 0, 255, 256, -257]
    df = spark.createDataFrame([(hashes,)], "hashes array<long>")
    for dims, kind in (((64, 256), "array<smallint>"), ((3, 32768), "array<int>"), ((2**31, 3), "array<bigint>")):
        out = df.select(R._buckets(dims).alias("b"))
        assert out.dtypes == [("b", kind)]
        got = np.array(out.first()["b"])
        for d in dims:
            assert (np.mod(got, d) == np.mod(np.array(hashes), d)).all()


def test_training_learns_and_a_checkpoint_returns_its_history(spark, tmp_path):
    import numpy as np
    from lexiframe.operators.training import Settings, fit, load_checkpoint, save_checkpoint
    rng = np.random.default_rng(1)
    rows = [([float(v) for v in rng.normal(size=4) + 2 * np.eye(4)[i % 3]], i % 3, 1.0, ("train", "train", "valid", "test")[i // 3 % 4])
            for i in range(600)]
    df = spark.createDataFrame(rows, "features array<double>, label int, weight double, phase string").repartition(3)
    settings = Settings(epochs=12, learning_rate=0.2)
    run = fit(df, 3, 4, settings)
    assert run.history[0]["train_loss"] == pytest.approx(np.log(3)) and len(run.history) == 12
    assert run.history[-1]["valid_acc"] > 0.7 and run.history[-1]["train_loss"] < 0.6
    x = np.array([r[0] for r in rows]); y = np.array([r[1] for r in rows]); test = np.array([r[3] == "test" for r in rows])
    acc = (run.last(x[test]).argmax(axis=1) == y[test]).mean()
    assert acc == pytest.approx(run.history[-1]["test_acc"])
    save_checkpoint(spark, run, settings, str(tmp_path / "run"))
    again, same = load_checkpoint(spark, str(tmp_path / "run"))
    assert same == settings and again.history == run.history
    assert (again.best_epoch, again.last_epoch) == (run.best_epoch, 12)
    assert again.best_epoch == min(range(12), key=lambda i: run.history[i]["valid_loss"]) + 1
    assert np.array_equal(again.best.weights, run.best.weights) and np.array_equal(again.last.bias, run.last.bias)


def _grid_examples(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    rows = [([int(v) for v in rng.integers(0, 40, 6) * (1 + i % 3)], i % 3, i % 2 if i % 11 else None,
             ("train", "train", "valid", "test")[i % 4], ("train", "valid")[i % 5 == 0], 0.5 + i % 3) for i in range(500)]
    df = spark.createDataFrame(rows + [(None, 1, 1, "train", "train", 1.0)],
                               "hashes array<long>, label3 int, label2 int, phase string, other string, weight double")
    return df.repartition(4)


def test_heads_trained_together_equal_separate_runs(spark):
    import numpy as np
    from lexiframe.operators.training import Head, Settings, fit_many
    heads = [Head("label3", 3, 16, Settings(4, 0.2)), Head("label3", 3, 32, Settings(3, 0.1, 0.01), "weight"),
             Head("label2", 2, 16, Settings(5, 0.3), None, "other")]
    df = _grid_examples(spark).persist()
    together = fit_many(df, heads)
    assert [r.last_epoch for r in together] == [4, 3, 5]
    for head, run in zip(heads, together):
        alone = fit_many(df, [head])[0]
        assert [list(r) for r in alone.history] == [list(r) for r in run.history]
        for a, b in zip(alone.history, run.history):
            assert all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-9 for k in a)
        assert np.allclose(alone.last.weights, run.last.weights, atol=1e-9)
        assert run.history[0]["train_loss"] == pytest.approx(np.log(head.classes))
        assert head.classes == 2 or run.history[-1]["train_loss"] < run.history[0]["train_loss"]  # label2 is noise
    assert together[2].history[0]["n_test"] == 0 and together[2].history[0]["test_loss"] is None
    assert together[2].history[0]["n_train"] + together[2].history[0]["n_valid"] == 500 - len(range(0, 500, 11))


def test_a_resumed_run_equals_an_uninterrupted_one_bit_for_bit(spark, tmp_path):
    import numpy as np
    from lexiframe.operators.training import Head, Settings, fit_many, load_checkpoint, save_checkpoint
    heads = [Head("label3", 3, 16, Settings(5, 0.2)), Head("label2", 2, 32, Settings(3, 0.4, 0.01), "weight")]
    path = str(tmp_path / "examples")
    _grid_examples(spark).write.parquet(path)
    df = spark.read.parquet(path)
    whole = fit_many(df, heads)
    for stop in range(0, 5):
        for i, run in enumerate(fit_many(df, heads, until=stop)):
            save_checkpoint(spark, run, heads[i].settings, str(tmp_path / f"{stop}-{i}"))
        back = [load_checkpoint(spark, str(tmp_path / f"{stop}-{i}"))[0] for i in range(len(heads))]
        again = fit_many(df, heads, back)
        for a, b in zip(whole, again):
            assert a.history == b.history and (a.best_epoch, a.last_epoch) == (b.best_epoch, b.last_epoch)
            for x, y in ((a.best.weights, b.best.weights), (a.last.bias, b.last.bias), (a.next.weights, b.next.weights),
                         (a.next.first, b.next.first), (a.next.second, b.next.second)):
                assert np.array_equal(x, y)


def test_encoded_scores_do_not_depend_on_batches(spark):
    import numpy as np
    from lexiframe.operators.models import ModularScorer, score_encoded
    rng = np.random.default_rng(3)
    rows = [(i, [int(v) for v in rng.integers(1, 999, int(rng.integers(0, 40)))], i % 4 - 1, "x") for i in range(200)]
    rows += [(500, None, 1, "x"), (501, [], 2, "x"), (502, [7] * 3000, 0, "x"), (503, [5], None, "x")]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>, target int, logits string").repartition(3)

    def run(scorer, cells, size=None):
        if size:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = score_encoded(df, ["k"], scorer, target="target", cells=cells)
            return {r["k"]: (r["logits"], r["pred"], r["loss"]) for r in got.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    whole = run(ModularScorer(3), 1 << 20)
    assert whole == run(ModularScorer(3), 256, 17) and len(whole) == 204
    assert whole[500] == (None, None, None) and whole[503][2] is None and whole[501][0] == [0.0, 0.0, 0.0]
    for k, ids, target, _ in rows:
        if ids:
            z = [sum((i + j + 1) * (2 * j + 1) % 101 for i in ids) / len(ids) / 10 for j in range(3)]
            assert whole[k][0] == pytest.approx(z) and whole[k][1] == z.index(max(z))
            if target is not None and 0 <= target < 3:
                assert whole[k][2] == pytest.approx(np.log(np.exp(z).sum()) - z[target])
            else:
                assert whole[k][2] is None


def test_labels_are_joined_to_scores_not_to_ids(spark):
    from lexiframe.operators.models import ModularScorer, score_encoded
    rows = [(i % 40 if i % 9 else None, [i % 7, 3 * i, 5], 3) for i in range(120)] + [(50, None, None), (51, [], 0), (52, [9], 1)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>, n int")
    labels = spark.createDataFrame([(i, i % 5 - 1, "x") for i in range(0, 60, 2)] + [(4, 0, "x"), (6, None, "x"), (None, 1, "x")],
                                   "k long, target int, more string")
    want = score_encoded(df.join(labels.select("k", "target"), "k", "left"), ["k", "n"], ModularScorer(3), target="target")
    got = score_encoded(df, ["k", "n"], ModularScorer(3), target="target", labels=labels, on="k")
    assert got.dtypes == want.dtypes
    plain = lambda d: sorted(str((r["k"], r["n"], r["target"], r["logits"], r["pred"], r["loss"] and round(r["loss"], 9)))
                             for r in d.collect())
    assert plain(got) == plain(want) and got.count() > df.count()


def test_score_encoded_shuffles_scores_for_the_labels(spark, tmp_path):
    from lexiframe.plans.queries import QUERIES
    docs = [(i, " ".join(f"Wort{'abcdefg'[j % 7]}" for j in range(i % 30))) for i in range(90)] + [(3, "noch eins"), (None, "ohne"), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2) for i in range(0, 90, 3)] + [(3, 0), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = QUERIES["score_encoded"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")  # the join is above the scorer
    got = [(r["doc_id"], r["target"]) for r in out.collect()]
    quality = {}
    for k, q in labels:
        quality.setdefault(k, []).append(q)
    want = [(k, q) for k, _ in docs for q in (quality.get(k) if k is not None and k in quality else [None])]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_token_table_keeps_nothing_of_its_own_size():
    import numpy as np
    import pyarrow as pa
    from lexiframe.operators.lookup import TokenTable
    words = [f"w{i}" for i in range(5000)]
    table = TokenTable(pa.array(words), np.arange(5000) + 4)
    held = set(vars(table))
    asked = pa.array(["w4999", None, "w", "w0", "w4999"] + [f"v{i}" for i in range(300)], pa.large_string())
    assert table.ids_of(asked, 1).tolist() == [5003, 1, 1, 4, 5003] + [1] * 300
    assert set(vars(table)) == held == {"tokens", "ids"}
    assert TokenTable(pa.array([], pa.string()), np.array([])).ids_of(pa.array(["a", None]), -5).tolist() == [-5, -5]


def test_a_vocabulary_within_the_bytes_moves_no_rows(spark, monkeypatch):
    """Three million short tokens are within 64 MB: looked up in batches, not joined."""
    from lexiframe.operators import lookup
    vocab = spark.range(3_000_000).select(F.col("id").cast("string").alias("token"), (F.col("id") + 4).cast("int").alias("id"))
    df = spark.createDataFrame([(1, ["5", "2999999", "x", None]), (2, None), (3, [])], "k long, tokens array<string>")
    out = E.encode(df, "k", "tokens", vocab, 9, pad=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "ArrowEval" in plan
    assert {r["k"]: r["input_ids"] for r in out.collect()} == {1: [2, 9, 3000003, 1, 1, 3], 2: None, 3: [2, 3]}


def test_written_intermediate_tables_are_packed_with_zstd(spark):
    import glob

    import pyarrow.parquet as pq
    from lexiframe.session import materialize
    df = materialize(spark.range(50), "packed")
    files = [f for d in df.inputFiles() for f in glob.glob(d.replace("file://", ""))]
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)


def test_packed_ids_come_back_and_small_ones_take_a_byte():
    import numpy as np
    import pyarrow as pa
    from lexiframe.operators import lookup as L
    rows = [[0, 1, 127, 128], None, [], [16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, -1, -2**31], [5] * 300]
    valid = np.array([r is not None for r in rows])
    flat, lengths = np.array([i for r in rows for i in r or []], np.int64), np.array([len(r or []) for r in rows])
    lists = L.packed(flat, lengths, valid)
    assert lists.value_lengths().to_pylist() == [5, None, 0, 2 + 3 + 3 + 4 + 5 + 5 + 5 + 5, 300] and lists.type == pa.list_(pa.int8())
    for part in (lists, pa.concat_arrays([lists, lists])[5:], lists[1:4], lists[:0], lists[1:3]):
        ids, n, ok = L.unpacked(part)
        whole = [r for r in (rows if len(part) == 5 else rows[1:4] if len(part) == 3 else rows[1:3] if len(part) == 2 else [])]
        assert ok.tolist() == [r is not None for r in whole] and n.tolist() == [len(r or []) for r in whole]
        assert ids.tolist() == [i for r in whole for i in r or []]


def test_rows_of_a_large_vocabulary_are_written_and_moved_packed(spark, monkeypatch):
    from lexiframe.operators import lookup
    vocab = spark.range(400).select(F.concat(F.lit("w"), F.col("id")).alias("token"), (F.col("id") + 4).cast("int").alias("id"))
    vocab = vocab.unionByName(spark.createDataFrame([("far", 2**31 - 1), ("below", -7), ("next", -1)], "token string, id int"))
    rows = [(i % 9 if i % 5 else None, [f"w{(i * j) % 450}" for j in range(i % 40)] + ["far", "below", None, "nowhere", "next"]) for i in range(80)]
    df = spark.createDataFrame(rows + [(1, None), (2, []), (2, [])], "k long, tokens array<string>")

    def ids():
        out = E.encode(df, "k", "tokens", vocab, 90, pad=False)
        return out, sorted(str((r["k"], r["input_ids"], r["n_tokens"])) for r in out.collect())

    small, written, keep = ids()[1], [], E.materialize
    monkeypatch.setattr(lookup, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(lookup, "HOT_TOKENS", 150)
    monkeypatch.setattr(E, "materialize", lambda d, name: written.append(keep(d, name)) or written[-1])
    out, large = ids()
    assert large == small
    assert dict(written[-1].select("_e.ids").dtypes)["ids"] == "array<tinyint>"  # int lists took twice the bytes
    moved = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in moved and moved.index("filled(") < moved.index("Join LeftOuter")  # unpacked after the move


def test_cleaned_texts_are_written_as_text(spark, tmp_path, monkeypatch):
    from lexiframe.plans import queries as Q
    docs = [(i, " ".join(f"Wort{'abcdefg'[j % 7]}," for j in range(i % 30))) for i in range(40)] + [(3, "noch  eins"), (None, "x\ny"), (7, None), (8, " ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    written, keep = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda d, name: written.append(d) or keep(d, name))
    toks = Q.written_tokens(spark, str(tmp_path))
    want = Q.doc_tokens(spark, str(tmp_path))
    assert [t for _, t in written[0].dtypes] == ["bigint", "string"] and toks.dtypes == want.dtypes
    assert sorted(map(str, toks.collect())) == sorted(map(str, want.collect()))


def test_micro_batches_are_bounded_in_cells():
    import numpy as np
    from lexiframe.operators.models import _micro_batches
    lengths = np.r_[np.random.default_rng(4).integers(0, 60, 500), 5000, 0]
    for cells in (1, 100, 4096, 1 << 20):
        parts = list(_micro_batches(lengths, cells))
        assert sorted(np.concatenate(parts)) == list(range(len(lengths)))
        assert all(len(p) == 1 or len(p) * max(lengths[p].max(), 1) <= cells for p in parts)
    assert list(_micro_batches(np.zeros(0, np.int64), 10)) == []


def test_look_up_tables_agree_with_plain_dictionaries():
    import pickle

    import numpy as np
    import pyarrow as pa
    from lexiframe.operators.lookup import IdTable, TokenTable
    words, ids = ["b", "", "a", "অ", "zz"], np.array([7, 4, 9, 5, 6], np.int32)
    table = TokenTable(pa.array(words), ids)
    asked = pa.array(["a", None, "zz", "missing", "", "a", "অ"])
    plain = dict(zip(words, ids.tolist()))
    want = [plain.get(t, 1) for t in asked.to_pylist()]
    assert table.ids_of(asked, 1).tolist() == want
    again = pickle.loads(pickle.dumps(table))  # the hash table does not travel
    assert again._known is None and again.ids_of(asked, 1).tolist() == want
    assert table.ids_of(pa.array([], pa.string()), 1).tolist() == []
    back = IdTable(ids, pa.array(words))
    assert back.names_of(pa.array([9, None, 0, 100, 4], pa.int32())).to_pylist() == ["a", None, None, None, ""]
    assert pickle.loads(pickle.dumps(back)).names_of(pa.array([6], pa.int32())).to_pylist() == ["zz"]
    assert IdTable(np.array([], np.int32), pa.array([], pa.string())).names_of(pa.array([3], pa.int32())).to_pylist() == [None]
