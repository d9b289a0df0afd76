"""Fields with processing: what a positional file gives, its plan, and the paths beyond the inline limits."""
import pytest
from pyspark.sql import functions as F

from lexiframe.sources import Field, LabelField, TextField, fields as S, learn_fields, read_fields, write_csv

ROWS = [(1, "Good good book", "pos"), (2, "bad, bad\nbook", "neg"), (3, "", "pos"), (4, None, None), (5, "good " * 9, "odd"),
        (5, "good " * 9, "odd"), (6, "unseen", "pos")]
SPEC = {"text": TextField(1, F.lower, max_len=6), "label": LabelField(2), "key": Field(0, "int")}


@pytest.fixture()
def path(spark, tmp_path):
    write_csv(spark.createDataFrame(ROWS, "k int, t string, l string").repartition(2), str(tmp_path / "x"))
    return str(tmp_path / "x")


def expected(rows, vocab, labels, pad=0):
    out = []
    for k, t, lab in rows:
        ids = None if t is None else [2] + [vocab.get(w, 1) for w in t.lower().split()[:4]] + [3]
        ids = ids + [0] * (pad - len(ids)) if pad and ids else ids
        out.append((ids, None if lab is None else labels.get(lab, len(labels)), k))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


VOCAB = {"good": 4, "bad": 5, "bad,": 6, "book": 7}


def test_learned_fields_encode_as_by_hand(spark, path):
    learned = learn_fields(spark, path, SPEC)
    vocab = {r["token"]: r["id"] for r in learned["text"].vocab.collect()}
    counts = {}
    for _, t, _ in ROWS:
        for w in (t or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    assert vocab == {w: i + 4 for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
    df = read_fields(spark, path, learned)
    assert df.columns == ["text", "label", "key"] and dict(df.dtypes) == {"text": "array<int>", "label": "int", "key": "int"}
    assert got(df) == expected(ROWS, vocab, {"pos": 0, "odd": 1, "neg": 2})


def test_given_tables_meet_unseen_tokens_and_labels_and_pad(spark, path):
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, id int")
    index = spark.createDataFrame([("pos", 0), ("neg", 1)], "label string, idx int")
    spec = {"text": TextField(1, F.lower, max_len=6, pad=True, vocab=vocab), "label": LabelField(2, index), "key": Field(0, "int")}
    assert got(read_fields(spark, path, spec)) == expected(ROWS, VOCAB, {"pos": 0, "neg": 1}, pad=6)


def test_one_plan_without_python_or_shuffle_of_the_file(spark, path):
    plan = read_fields(spark, path, learn_fields(spark, path, SPEC))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "from_json" not in plan
    assert "Join" not in plan and "Aggregate" not in plan and "Repartition" not in plan


def test_tables_beyond_the_limits_are_joined_with_the_same_rows(spark, path, monkeypatch):
    from lexiframe.operators import lookup
    learned = learn_fields(spark, path, SPEC)
    want = got(read_fields(spark, path, learned))
    monkeypatch.setattr(S, "INLINE_ENTRIES", 0)
    monkeypatch.setattr(lookup, "BROADCAST_TOKENS", 0)
    assert got(read_fields(spark, path, learned)) == want


def test_empty_file_and_wrong_positions(spark, tmp_path):
    write_csv(spark.createDataFrame([], "k int, t string, l string"), str(tmp_path / "e"))
    learned = learn_fields(spark, str(tmp_path / "e"), SPEC)
    assert read_fields(spark, str(tmp_path / "e"), learned).collect() == []
    with pytest.raises(ValueError):
        read_fields(spark, str(tmp_path / "e"), {"a": Field(-1)})
