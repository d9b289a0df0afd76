import hashlib
import random

import numpy as np

from lexiframe.llm import fingerprints as P


def test_rows_match_direct_computation(documents, real):
    r = random.Random(5)
    rows = [(i, t) for i, t, _ in real[:60]] + [(900, None), (901, ""), (902, "abc"), (None, "x y z é\U0001f600" * 40), (5000, "q"),
            (5001, "z" * 140_000 + "é"), (5002, "z" * 140_000), (5003, "".join(r.choice("ab") for _ in range(300_000)))]
    got = {r["doc_id"]: r for r in P.against_next(documents(rows, 5)).collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        g = got[i]
        assert g["n_chars"] == len(a) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert g["fingerprint"] == P.fingerprint(a) and g["edited_fingerprint"] == P.fingerprint(edited)
        assert g["near_edited"] == P.likeness(P.fingerprint(a), P.fingerprint(edited))
        assert g["near_next"] == P.likeness(P.fingerprint(a), P.fingerprint(b))

        def common(x, y):
            n = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), None)
            return min(len(x), len(y)) if n is None else n

        assert g["common_edited"] == common(a, edited) and g["common_next"] == common(a, b)
    assert len(got) == len(rows)


def test_few_rows_and_ties(documents):
    one = P.against_next(documents([(1, "abcd")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert P.against_next(documents([])).collect() == []
    rows = [(1, "same text")] * 3 + [(2, "other")] * 2 + [(None, "n")] * 2
    assert len(P.against_next(documents(rows)).collect()) == 7


def test_equality_and_extension_across_chunks():
    r = random.Random(9)
    a = "".join(r.choice("abc") for _ in range(2 * P.CHUNK + 5000))
    b = a[:P.CHUNK + 77] + "X" + a[P.CHUNK + 78:]
    p, q = P.Prefixes(P.code_points(a)), P.Prefixes(P.code_points(b))
    assert p.extension(0, q, 0) == P.CHUNK + 77
    assert p.equal(P.CHUNK + 100, q, P.CHUNK + 100, P.CHUNK) and not p.equal(5, q, 6, 1000)
    assert p.extension(len(a), q, 0) == 0
    assert p.span(3, 3) == (0, 0)


def test_span_hashes_do_not_depend_on_place():
    codes = P.code_points("hello world, hello world, hello world and more")
    h = P.span_hashes(codes, 5)
    assert h[0] == h[13] == h[26] and len(np.unique(h)) < len(h)


def test_likeness_follows_common_spans():
    r = random.Random(11)
    base = "".join(r.choice("abcdefgh ") for _ in range(4000))
    near = base[:3600] + "".join(r.choice("abcdefgh ") for _ in range(400))
    far = "".join(r.choice("abcdefgh ") for _ in range(4000))
    f = P.fingerprint
    assert P.likeness(f(base), f(base)) == 1 and P.likeness(f(base), f(near)) > 0.6 and P.likeness(f(base), f(far)) < 0.1
    assert P.likeness(f(""), f("")) == 1 and P.likeness(f(""), f(base)) == 0
