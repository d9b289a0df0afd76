import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lexiframe.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.parse_ranks(bpe.read_rank_file(PATH)), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def odd_texts():
    r = random.Random(1)
    mixed = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x100, 0x2000), r.randrange(0x1F300, 0x1F700)]))
                     for _ in range(400)) for _ in range(20)]
    letters = ["".join(r.choice("abcdetinghsou") for _ in range(r.randrange(1, 3000))) for _ in range(20)]
    return mixed + letters + ["", " ", "a" * 5000, "ab" * 3000, " " * 2000, "\r\n" * 99, "<|endoftext|>", "don't WE'LL 12345 $$$  x",
                              "\x00\x01", "é\U0001f600 \n\n  x\t\t "]


def test_ids_equal_the_library(codec, library, real):
    for text in odd_texts() + [t for _, t, _ in real]:
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_compatible_pairs_are_those_that_merges_leave(codec):
    r = random.Random(2)
    tokens = list(codec.ranks.items())
    for _ in range(3000):
        (a, i), (b, j) = r.choice(tokens), r.choice(tokens[:2000])
        want = [codec.ranks[x] for x in bpe.merge_bytes(a + b, codec.ranks)] == [i, j]
        assert codec.compatible(i, j) == want, (a, b)


def test_small_vocabulary_with_a_token_no_merge_makes():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    codec = bpe.Codec(ranks, r"\S+|\s+")
    library = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "bcab", "xyz", "wxyz", "abcabc", "aabcc", "xyzxyz"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_query_rows_and_general_interface(documents, library):
    rows = [(1, None), (2, ""), (None, "hello world"), (None, "hello world"), (3, "a" * 200_000)]
    df = documents(rows)
    got = [r.asDict() for r in bpe.round_trip(df, PATH, P.PATTERN, "doc_id", with_ids=True).collect()]
    want = sorted((str(i), library.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded_sha256"]) for r in got) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN, "doc_id"), PATH, P.PATTERN, "doc_id").collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"]).decode()) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(documents([]), PATH, P.PATTERN, "doc_id").collect() == []
