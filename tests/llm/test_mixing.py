import collections

from lexiframe.llm import mixing


def mixed(df):
    return [r.asDict() for r in mixing.mix(df).collect()]


def test_targets_share_the_total_and_are_capped(documents):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 4 != 3 else None) for i in range(400)] + [(1000, "x " * 3, "tiny")]
    got = mixed(documents(rows))
    assert len(got) == 401
    total = sum(r["size"] for r in got)
    target = {r["source"]: r["target"] for r in got}
    size = {r["source"]: r["source_size"] for r in got}
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert target["tiny"] == 9.0 and all(target[s] <= 3 * size[s] for s in target)
    # s0 1, s1 2, s2 3, tiny 1, null 2
    assert abs(target["s1"] - 2 * target["s0"]) < 1e-6 and abs(target["s2"] - 3 * target["s0"]) < 1e-6
    taken = collections.Counter()
    for r in got:
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)
    assert sum(taken.values()) <= total


def test_one_hot_source_and_reruns_agree(documents):
    rows = [(i, "w " * (i % 5), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    a = sorted(map(str, mixed(documents(rows, 2))))
    assert a == sorted(map(str, mixed(documents(rows, 7))))


def test_many_sources_take_range_partitions(documents, monkeypatch):
    rows = [(i, "w " * (i % 5), f"s{i % 37}") for i in range(300)]
    a = sorted(map(str, mixed(documents(rows))))
    monkeypatch.setattr(mixing, "SOURCES_IN_ONE_TASK", 0)
    assert a == sorted(map(str, mixed(documents(rows))))


def test_odd_rows(documents):
    got = mixed(documents([(1, None, "a"), (2, "", "a"), (None, "q", "c"), (None, "q", "c"), (4, "x y", None), (4, "x y", None)]))
    assert len(got) == 6
    assert sorted((r["size"], r["taken"]) for r in got if r["source"] == "a") == [(0, 0), (0, 0)]
    assert mixed(documents([(1, "", "a")]))[0]["taken"] == 0
    assert mixed(documents([])) == []


def test_words_split_at_ascii_white_space_only(documents):
    assert mixed(documents([(1, " a b \t\x0b c d\n", "s")]))[0]["size"] == 2


def test_resample_repeats_whole_rows(documents):
    rows = [(i, f"w{i} " * (1 + i % 7), f"s{i % 4}") for i in range(200)] + [(3, "w3 " * 4, "s3")]
    df = documents(rows)
    out = mixing.resample(df)
    assert out.columns == df.columns
    counts = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert set(counts) <= {(r[0], r[1]) for r in rows} and max(counts.values()) <= 6
    words = sum(len(t.split()) * n for (_, t), n in counts.items())
    total = sum(len(r[1].split()) for r in rows)
    assert total - 8 <= words <= total
    assert mixing.resample(documents([])).count() == 0


def test_resample_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "__key", "__copies", "__text", "__copy", "copies", "row", "key", "id", "src", "its_id", "col"]
    rows = [tuple([i, f"w{i} " * (1 + i % 4), f"s{i % 2}"] + [f"{n}{i}" for n in names[3:]]) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = mixing.resample(df)
    assert out.columns == names
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= set(rows)
    plain = mixing.resample(df.select("doc_id", "text", "source")).collect()
    assert sorted(r[:3] for r in got) == sorted(map(tuple, plain))
