"""The suffix tree against a direct one over tuples of words."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexiframe.llm import suffix_tree as S
from lexiframe.session import _scratch

END = object()
SMALL = {"depth": 3, "min_context": 4, "min_next": 2, "gain": 1.0}


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), END]


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class Tree:
    def __init__(self, texts, depth, min_context, min_next, gain, discount=S.DISCOUNT):
        self.depth = depth
        count = [Counter() for _ in range(depth + 1)]
        for t in texts:
            w = tokens(t)
            for k in range(depth + 1):
                count[k].update(tuple(w[i - k:i + 1]) for i in range(k, len(w)))
        self.c = {k[0]: n for k, n in count[0].items()}
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.states = {}  # context -> (left, {symbol: own part})
        for k in range(1, depth + 1):
            follow = defaultdict(dict)
            for seq, n in count[k].items():
                if n >= min_next and count[k - 1][seq[:-1]] >= min_context:
                    follow[seq[:-1]][seq[-1]] = n
            new = {}
            for s, nexts in follow.items():
                total = count[k - 1][s]
                left = 1 - sum(n - discount for n in nexts.values()) / total
                above = {x: self.p(x, s[1:]) for x in nexts}
                own = {x: (n - discount) / total for x, n in nexts.items()}
                saved = sum(n * math.log2((own[x] + left * above[x]) / above[x]) for x, n in nexts.items())
                saved += (total - sum(nexts.values())) * math.log2(left)
                if saved >= gain * (len(nexts) + 1):
                    new[s] = (left, own)
            self.states.update(new)

    def p(self, x, context):
        for i in range(len(context) + 1):
            s = tuple(context[i:])
            if s in self.states:
                left, own = self.states[s]
                return own.get(x, 0.0) + left * self.p(x, s[1:])
        return (self.c.get(x, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))

    def score(self, text):
        w = tokens(text)
        root = [math.log10((self.c.get(x, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w]
        full = [math.log10(self.p(x, w[max(0, i - self.depth):i])) for i, x in enumerate(w)]
        return len(w), sum(x in self.c for x in w), sum(root), sum(full)


def check(spark, documents, rows, settings, limit):
    got = S.score_documents(documents(rows), limit=limit, **settings).collect()
    tree = Tree([t for i, t in rows if not is_held_out(i)], **settings)
    want = sorted((i is None, i or 0, tree.score(t)) for i, t in rows)
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(r)[2:4] + tuple(r)[5:]) for r in got)
    assert [w[:2] for w in want] == [h[:2] for h in have]
    for (*_, w), (*_, h) in zip(want, have):
        assert w[:2] == h[:2] and math.isclose(w[2], h[2], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(w[3], h[3], rel_tol=1e-5, abs_tol=1e-5)  # looked-up numbers are 32-bit
    assert {r["train_tokens"] for r in got} <= {tree.n} and all(r["held_out"] == is_held_out(r["doc_id"]) for r in got)
    return tree, got


def prose(n, seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "naïve", "THE"]
    follow = {w: random.sample(words, 3) for w in words}
    out = []
    for i in range(n):
        w, text = random.choice(words), []
        for _ in range(random.randint(0, 40)):
            text.append(w)
            w = random.choice(follow[w]) if random.random() < 0.8 else random.choice(words)
        out.append((i, random.choice([" ", "\t", "\n  "]).join(text)))
    return out


ODD = [(None, "w1 w2 w3 unseen"), (500, None), (501, ""), (502, " \n\t "), (503, "w1"), (503, "w1"), (504, "W1 w1\x0bw2"), (505, "a b c\x1fd")]


@pytest.mark.parametrize("limit", [S.BROADCAST_KEYS, 0])
def test_equals_the_direct_tree(spark, documents, limit):
    tree, got = check(spark, documents, prose(150, 4) + ODD, SMALL, limit)
    assert {len(s) for s in tree.states} == {1, 2, 3}
    whole = [r for r in got if r["n_tokens"] > 10 and r["held_out"]]
    assert sum(r["score"] for r in whole) > sum(r["base_score"] for r in whole)  # better on texts it has not seen


@pytest.mark.parametrize("limit", [S.BROADCAST_KEYS, 0])
def test_few_rows(spark, documents, limit):
    assert S.score_documents(documents([]), limit=limit).collect() == []
    check(spark, documents, [(i, t) for i, t in ODD if is_held_out(i)] or [(None, "x y")], SMALL, limit)
    check(spark, documents, [(None, "only held out"), (None, None)], SMALL, limit)


@pytest.mark.parametrize("limit", [1, 100])
def test_some_keys_in_place_the_others_asked_for(spark, documents, monkeypatch, limit):
    monkeypatch.setattr(S, "BUCKET_KEYS", 500)  # several buckets
    tree, _ = check(spark, documents, prose(150, 5) + ODD, SMALL, limit)
    assert len(tree.c) + len(tree.states) + sum(len(own) for _, own in tree.states.values()) > 100


def test_no_copy_of_the_texts_is_written(spark, documents):
    def written():
        paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _scratch]
        found = [(p, p.getFileSystem(spark._jsc.hadoopConfiguration())) for p in paths]
        return sum(s.getContentSummary(p).getLength() for p, s in found if s.exists(p))

    rng = random.Random(6)
    words = [f"{rng.getrandbits(80):x}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=500))) for i in range(800)]
    before = written()
    assert len(S.score_documents(documents(rows), limit=0).collect()) == len(rows)
    assert written() - before < 0.1 * sum(len(t) for _, t in rows)


def test_distributions_sum_to_one():
    tree = Tree([t for _, t in prose(80, 9)], **SMALL)
    unseen = "never"
    for s in [(), *random.Random(1).sample(sorted(tree.states, key=str), 20)]:
        assert math.isclose(sum(tree.p(x, s) for x in [*tree.c, unseen]), 1, rel_tol=1e-9)


def test_real_table(spark, documents, real):
    rows = [(r[0], r[1]) for r in real]
    check(spark, documents, rows, {"depth": 2, "min_context": 16, "min_next": 2, "gain": 4.0}, S.BROADCAST_KEYS)


def test_long_text_and_small_steps(monkeypatch):
    text = "one two " * 200_000 + "x" * 3_000_000
    w, off = S.symbols(pa.array([text, None, "two"]))
    assert off.tolist() == [0, 400_002, 400_003, 400_005] and w[1] == w[-2] and w[-1] == S.END
    _, (at1, e1, c1, l1), (at2, e2, c2, l2) = S.chains(w, off, 2)
    assert len(e1) == len(w) - 3 and len(e2) == len(w) - 5 and at1[0] == 1 and at2[0] == 2
    assert len(np.unique(e1[:399_998])) == 2
    assert (c1 == w[at1 - 1]).all() and (l1 == w[at1]).all() and c2[0] == e1[0] and l2[0] == e1[1]


def test_packs_round_trip():
    rng = np.random.default_rng(2)
    context = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    lower, counts = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(1, 1 << 40, 5000)
    for part in (slice(None), slice(0, 1)):
        back = S.unpack(*S.pack(context[part], lower[part], counts[part]))
        assert all((a == b[part]).all() for a, b in zip(back, (context, lower, counts)))
