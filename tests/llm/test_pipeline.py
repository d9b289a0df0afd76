import hashlib

import corpus_pipeline as C
from conftest import SF001
from lexiframe.llm import mixing, near_dedup, quality, secrets
from lexiframe.session import materialize, read_table


def test_stages_in_order_each_on_what_the_one_before_kept(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    docs = first = read_table(spark, SF001, "documents")
    seen = [docs]
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF001), f"test-{name}")
        if name != "tokens":
            assert docs.columns == first.columns
        seen.append(docs)
    ids = [[r[0] for r in d.select("doc_id").collect()] for d in seen]
    # quality: what the classifier accepts
    good = {r["doc_id"] for r in quality.classify(first, read_table(spark, SF001, "labels")).collect() if r["predicted"]}
    assert sorted(ids[1]) == sorted(good) and 0 < len(good) < len(ids[0])
    # near duplicates: one of each class, its smallest id
    classes = {r["class_id"] for r in near_dedup.near_classes(seen[1]).collect()}
    assert sorted(ids[2]) == sorted(classes)
    # secrets: same documents, nothing left to find
    assert sorted(ids[3]) == sorted(ids[2])
    assert all(not [s for s in r["spans"] if s["kind"] in ("assign", "access", "hex")] for r in secrets.scan(seen[3]).collect())
    # mix: as often as the mix takes each
    size = {r["doc_id"]: len(r["text"].split()) for r in seen[3].collect()}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) <= mixing.MAX_REPEATS
    assert abs(sum(size[i] for i in ids[4]) - sum(size.values())) <= max(size.values())
    # tokens: the decoded bytes are the text
    text = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert sorted(ids[5]) == sorted(ids[4])
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"]


def test_run_equals_the_stages(spark):
    a = sorted((r["doc_id"], r["ids_sha256"]) for r in C.run(spark, SF001).collect())
    b = sorted((r["doc_id"], r["ids_sha256"]) for r in C.run(spark, SF001).collect())
    assert a == b and a
