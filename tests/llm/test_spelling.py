"""Spelling variants against all pairs by edit distance."""
import random
import re
import zlib
from collections import Counter

import pytest

from lexiframe.llm import spelling as S


def brute_counts(rows, min_length=5, min_count=3):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_length and n >= min_count}


def brute_near(words):
    """All pairs at distance one, by the definition: same word after one code point goes, or one differs."""
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1:]), set()).add(w)  # replaced at i
    near = {w: set() for w in words}
    for same in by.values():
        for w in same:
            near[w] |= same - {w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in near:
                near[w].add(v)
                near[v].add(w)
    return near


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio=2):
    near, out, form = brute_near(words), [], {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def group(spark, words, parts=3):
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(parts)
    return sorted(tuple(r) for r in S.group_variants(df).collect())


def test_the_brute_force_is_right():
    random.seed(3)
    words = {"".join(random.choices("ab", k=random.randint(1, 5))): 1 for _ in range(60)}
    near = brute_near(words)
    assert all((v in near[w]) == distance_one(w, v) for w in words for v in words)


@pytest.mark.parametrize("letters,most", [("ab", 7), ("abc", 6), ("aéß", 5), ("abcdefghij", 4)])
def test_dense_dictionaries(spark, letters, most):
    random.seed(most)
    words = {"".join(random.choices(letters, k=random.randint(1, most))): random.choice([1, 2, 3, 5, 9, 20, 80]) for _ in range(150)}
    assert group(spark, words, parts=5) == brute(words)


def test_ties_chains_and_prefix_words(spark):
    words = {"house": 4, "mouse": 4, "louse": 2, "houses": 8, "housed": 8, "housse": 1, "hose": 16, "hoose": 2, "a": 1, "aa": 2,
             "aaa": 4, "aaaa": 8, "aaaaa": 16, "zzzzzz": 5}
    got = group(spark, words)
    assert got == brute(words)
    by = {r[0]: r for r in got}
    assert by["louse"][1] == "house" and by["a"][2] == "aaaaa" and by["zzzzzz"][1:3] == (None, "zzzzzz")
    assert by["house"][1] == "hose"  # 16 of hose, over the 8 of housed and houses


def test_very_long_words(spark):
    long = "xy" * 20_000
    words = {long: 9, long[:-1]: 2, long[:5] + "q" + long[5:]: 3, long[:100] + "é" + long[101:]: 4, "short": 1}
    assert group(spark, words) == brute_long(words)


def brute_long(words):
    out = []
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and S.shared_prefix(v, w) + S.shared_prefix(v[::-1], w[::-1])
                >= max(len(v), len(w)) - 1]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        on = best if best is not None and words[best] >= 2 * n else None
        out.append((w, on, on or w, n, len(near), words[on] if on else None))
    return sorted(out)


ODD = [(1, None), (2, ""), (3, "Hello HELLO hello Hellô hellO World"), (3, "Hello HELLO hello Hellô hellO World"),
       (None, "hello-world hello_world× x1y2"), (None, None), (7, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ ĀĀnotlatin")]


def test_counts_of_odd_rows(spark, documents):
    got = dict(S.count_words(documents(ODD), 2, 1).collect())
    assert got == brute_counts(ODD, 2, 1)
    assert S.spelling_variants(documents([])).collect() == []
    assert S.spelling_variants(documents([(1, None), (2, "only short and rare")])).collect() == []


def test_slices_cut_no_run(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 7)
    text = "Abcdefghijklmnop qrs, tuv  wxyz" * 3 + "é" * 40
    assert S.runs_of(5, text) == brute_counts_of(5, text)


def brute_counts_of(doc_id, text):
    return Counter(brute_counts([(doc_id, text)], 0, 1))


def test_real_table_equals_all_pairs(spark, documents, real):
    rows = [(r[0], r[1]) for r in real]
    got = sorted(tuple(r) for r in S.spelling_variants(documents(rows)).collect())
    assert got == brute(brute_counts(rows)) and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_node_numbers_are_one_per_prefix(spark):
    random.seed(8)
    words = sorted({"".join(random.choices("abc", k=random.randint(1, 7))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    got = {r["word"]: r for r in S.number_nodes(df, "word", "path", "rank").collect()}
    nodes = {}
    for w, r in got.items():
        assert len(r["path"]) == len(w) + 1 and words[r["rank"]] == w
        for i, node in enumerate(r["path"]):
            assert nodes.setdefault(w[:i], node) == node
    assert len(set(nodes.values())) == len(nodes) == max(nodes.values()) + 1 or len(set(nodes.values())) == len(nodes)
