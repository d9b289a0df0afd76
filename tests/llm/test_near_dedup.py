import collections
import random

import numpy as np

from lexiframe.llm import near_dedup as N
from lexiframe.llm.shingles import shingle_hashes, word_hashes


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (same and same >= 0.8 * (len(sets[i]) + len(sets[j]) - same)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    best = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[i][0]), str(best[find(i)])) for i in range(len(rows)))


def family(seed, n, words=120, edits=6):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def got(df, **kw):
    return sorted((str(r["doc_id"]), str(r["class_id"])) for r in N.classes(df, **kw).collect())


def test_classes_match_all_pairs(documents, real):
    texts = family(1, 40) + family(2, 25, edits=9) + family(3, 10, words=30, edits=3)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(500 + i, t) for i, t in enumerate(texts[:5])] + [(800 + r[0], r[1]) for r in real[:150]]
    assert got(documents(rows)) == brute(rows)
    assert got(documents(rows), block=7) == brute(rows)  # buckets in blocks


def test_hub_salting_changes_nothing(documents, monkeypatch):
    rows = [(i, t) for i, t in enumerate(family(4, 60))]
    monkeypatch.setattr(N, "HUB_PARTNERS", 5)
    assert got(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, "x " * 5000), (8, "x " * 5000 + "y"),
            (None, "only here in this text"), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (10, "q" * 100_000)]
    want = {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "6", "10": "10", "9": "9", "None": "None"}
    for doc, cls in got(documents(rows)):
        assert want.get(doc, cls) == cls
    assert len(got(documents(rows))) == len(rows)
    assert got(documents([])) == []


def test_keep_one_keeps_the_smallest_id_with_all_columns(documents):
    rows = [(i, t) for i, t in enumerate(family(5, 12, edits=2))] + [(20, "p q r s t u"), (90, "p q r s t u"), (20, "p q r s t u"), (91, None)]
    df = documents(rows)
    out = N.keep_one(df)
    assert out.columns == df.columns
    kept = [str(r["doc_id"]) for r in out.select("doc_id").collect()]
    assert sorted(kept) == sorted({c for _, c in brute(rows)}) and "20" in kept and "90" not in kept and "91" in kept


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = (np.arange(1, 301, dtype=np.uint64) * np.uint64(7919), rng.integers(1, 40, 300) / 4)
    b = (a[0][50:], np.maximum(0.25, a[1][50:] + rng.integers(-4, 9, 250) / 4))
    s = N.dart_signatures([a, b], 4000)
    weight = dict(zip(a[0], a[1]))
    shared = sum(min(weight[e], w) for e, w in zip(*b))
    true = shared / (a[1].sum() + b[1].sum() - shared)
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    assert (N.dart_signatures([(np.zeros(0, np.uint64), np.zeros(0))], 8) == 0).all()
    one = N.dart_signatures([(np.array([5], np.uint64), np.array([1e9]))] * 2, 16)
    assert (one[0] == one[1]).all() and (one != 0).all()


def test_shingles_are_the_words_of_the_text():
    texts = ["a b c d e f", "  a b\tc d e  f ", "a b", "", "x", "a b c d e"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    w, at = word_hashes(raw, off)
    assert np.diff(at).tolist() == [6, 6, 2, 0, 1, 5]
    h, ends = shingle_hashes(raw, off, 5)
    parts = [h[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert parts[0] == parts[1] and parts[0][0] == parts[5][0] and [len(p) for p in parts] == [2, 2, 1, 0, 1, 1]


def test_keep_one_keeps_columns_of_any_name(spark):
    from lexiframe.llm.near_dedup import keep_one
    names = ["doc_id", "text", "__key", "__digest", "__id", "digest", "row", "key", "id", "kept_id", "kept_digest"]
    texts = ["one two three four five six seven eight", "another text that is not like the first at all"]
    rows = [tuple([i, texts[i % 2]] + [f"{n}{i}" for n in names[2:]]) for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = keep_one(df)
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == rows[:2]
