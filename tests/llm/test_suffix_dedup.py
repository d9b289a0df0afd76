import hashlib
import random

import numpy as np
import pytest

from lexiframe.llm import suffix_dedup as S


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for i, t in order:
        b = (t or "").encode()
        covered = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - S.WIDTH + 1):
            w = b[k:k + S.WIDTH]
            if w in seen:
                covered[k:k + S.WIDTH] = True
            else:
                seen.add(w)
        spans = sum(1 for z in range(len(b)) if covered[z] and (z == 0 or not covered[z - 1]))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((str(i), len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, **kw):
    return sorted((str(r[0]), *r[1:]) for r in S.remove_repeats(df, digest_only=True, **kw).collect())


@pytest.fixture(scope="module")
def planted():
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh \n") for _ in range(5000))
    line = "".join(r.choice("xyzw ") for _ in range(130))
    rows = [(1, None), (2, ""), (3, "a" * 1000), (4, base), (5, base[1000:1100]), (6, base[1000:1099]),
            (7, "é" * 200 + base[77:300] + "q" * 50 + base[4000:4500]), (8, base), (9, "The The " * 200), (10, "b" * 99), (11, "b" * 99),
            (12, "a" * 100), (13, base[:2500] + "!" + base[2500:])]
    noise = lambda: "".join(r.choice("lmnop") for _ in range(r.randrange(0, 150)))
    return rows + [(100 + i, noise() + line + noise()) for i in range(60)]


def test_planted_repeats(documents, planted):
    assert run(documents(planted, 5)) == brute(planted)


def test_hot_leads_take_the_digest_path(documents, planted):
    assert run(documents(planted, 5), group=20) == brute(planted)


def test_repeated_and_null_ids(documents, planted):
    rows = planted + [(4, planted[3][1]), (4, "zz" + planted[3][1]), (None, planted[3][1]), (None, "nn" + planted[20][1]), (None, "nn" + planted[20][1])]
    assert run(documents(rows, 5)) == brute(rows)
    assert run(documents([])) == []


def test_real_documents(documents, real):
    rows = [(i, t) for i, t, _ in real]
    assert run(documents(rows)) == brute(rows)


def test_kept_bytes(documents, planted):
    out = {str(r["doc_id"]): bytes(r["kept"]) for r in S.remove_repeats(documents(planted)).collect()}
    assert out["4"] == planted[3][1].encode() and out["5"] == b"" and out["6"] == planted[5][1].encode() and out["8"] == b""


def test_anchors_cover_every_window_and_pieces_do_not_matter(monkeypatch):
    r = random.Random(7)
    text = np.frombuffer("".join(r.choice("abcd") for _ in range(30_000)).encode(), np.uint8)
    at, h = S.anchors(text)
    assert np.diff(at).max() <= S.SPAN and at[0] < S.SPAN and at[-1] >= len(text) - S.WIDTH
    monkeypatch.setattr(S, "PIECE", 4000)
    again, g = S.anchors(text)
    assert (at == again).all() and (h == g).all()


def test_multikey_order_is_the_order_of_bytes():
    rows = np.random.default_rng(0).integers(0, 2, (500, 30)).astype(np.uint8)
    order, common = S.multikey_order(rows)
    as_bytes = [r.tobytes() for r in rows[order]]
    assert as_bytes == sorted(as_bytes)
    for a, b, c in zip(as_bytes, as_bytes[1:], common[1:]):
        assert a[:c] == b[:c] and (c == 30 or a[c] != b[c])
