import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models

from lexiframe.llm import token_counts as T

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return T.read_pieces(f.read())


def test_model_file(pieces):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table, fallback = pieces
    assert fallback
    for i in range(300, sp.get_piece_size(), 997):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            assert table[sp.id_to_piece(i)] == sp.get_score(i)


def brute(text, pieces, unknown):
    """Plain Viterbi over the whole text, positions by start, strictly better paths only; bytes for unknowns."""
    s = "▁" + text.replace(" ", "▁") if text else ""
    best = {0: (0.0, 0)}
    longest = max(map(len, pieces))
    for a in range(len(s)):
        score, n = best[a]
        for b in range(a + 1, min(len(s), a + longest) + 1):
            p = pieces.get(s[a:b])
            if p is not None and (b not in best or score + p > best[b][0]):
                best[b] = (score + p, n + 1)
        if s[a] not in pieces and (a + 1 not in best or score + unknown > best[a + 1][0]):
            best[a + 1] = (score + unknown, n + len(s[a].encode()))
    return best[len(s)][1]


def test_counts_equal_plain_viterbi(pieces, real):
    counter = T.Counter(*pieces)
    r = random.Random(3)
    texts = [t[:600] for _, t, _ in real[:60]] + ["", " ", "  a  b ", "\n\n", "a\tb\r\n\x00c", "é\U0001f600 \U0001f680\U0001f680", "日本語 テキスト"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x100, 0x2000)])) for _ in range(200)) for _ in range(20)]
    for t in texts:
        assert counter.count(t) == brute(t, pieces[0], counter.unknown), repr(t[:60])


def test_counts_equal_the_public_unigram_tokenizer(pieces, real):
    vocabulary = [("<unk>", 0.0), *pieces[0].items()]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    counter = T.Counter(dict(vocabulary), False)
    for _, t, _ in real[:80]:
        assert counter.count(t) == len(library.encode(T.SPACE + t.replace(" ", T.SPACE)).ids)


def test_ties_keep_the_earliest_start():
    # ab|c and a|bc score the same: bc starts earlier than c, so the last piece is bc; three pieces tie too
    counter = T.Counter({"▁": 0.0, "a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0}, True)
    assert counter.count("abc") == 2  # the space and abc


def test_rows(documents):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 50_000)]
    got = {str(r["doc_id"]): r["n_tokens"] for r in T.count_tokens(documents(rows), PATH, "doc_id").collect()}
    assert got["1"] == got["2"] == 0 and got["3"] > 50_000 and len(got) == 4
    assert T.count_tokens(documents([]), PATH, "doc_id").collect() == []


def test_a_long_text_without_spaces_needs_little_memory():
    import tracemalloc
    from lexiframe.llm.token_counts import Counter
    counter = Counter({"a": -1.0, "ab": -1.5, "b": -1.2, "abba": -2.0}, True)
    text = "abbaab" * 100_000
    assert counter.count_segment(text) == 100_000 * counter.count_segment("abbaab")
    tracemalloc.start()
    counter.count_segment(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000  # not a list a character
