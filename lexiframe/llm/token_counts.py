"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

The best segmentation of a text maximises the sum of the piece scores. An
Aho-Corasick automaton lists every vocabulary piece that ends at every
position; dynamic programming carries, per position, the best score and the
number of pieces of the path that has it. No path is stored.

Tie rules of the public unigram tokenizer: positions are visited in ascending
order of the piece's start, and a path is replaced only by a strictly better
one, so among equal scores the earliest start (the longest last piece) stays.
A character that no single-character piece covers is an unknown piece of score
``lowest score - 10``; with byte fallback it counts one piece per UTF-8 byte,
otherwise a run of unknown characters counts one piece. A space becomes U+2581
and one is put before a non-empty text.

No vocabulary piece has U+2581 after another character (checked), so the best
segmentation splits there, and so it does around characters that occur in no
piece. Segments are scored once and remembered (a bounded table per worker).

The model file is a sentencepiece model, read on the driver (under 1 MB) and
broadcast: its normal pieces and their scores are the vocabulary.

Defined results: a null text counts as empty, an empty text has 0 tokens; a
null or repeated ``doc_id`` keeps its rows; a very long text, also without any space, takes a few copies of
itself in memory and a state of the longest piece's length. Other columns of any name play no part.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, text_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_SEGMENTS = 400_000
MEMO_SEGMENT_CHARS = 64
NORMAL, BYTE = 1, 6  # piece types of the model format


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a message in the protocol buffers wire format."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            value, at = data[at:at + 4], at + 4
        yield key >> 3, value


def read_pieces(data: bytes) -> tuple[dict[str, float], bool]:
    """(piece -> score of the normal pieces, whether unknown characters fall back to bytes)."""
    pieces, fallback = {}, False
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            kind = f.get(3, NORMAL)
            if kind == NORMAL:
                pieces[f[1].decode("utf-8")] = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
            fallback |= kind == BYTE
    return pieces, fallback


class _Memo(dict):
    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, segment: str) -> int:
        n = self.count(segment)
        if len(segment) <= MEMO_SEGMENT_CHARS:
            if len(self) >= MEMO_SEGMENTS:
                self.clear()
            self[segment] = n
        return n


class Counter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        self.byte_fallback = byte_fallback
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.matcher = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.matcher.add_word(p, (len(p), score))
        if len(self.matcher):
            self.matcher.make_automaton()
        self.known = set("".join(pieces))
        self.longest = max(map(len, pieces), default=1)
        # one segment: a run of spaces and what follows it, cut around unknown white space
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        stops = "".join(c for c in "\n\t\r" if c not in self.known and byte_fallback)
        stop = regex.escape(stops) if stops else ""
        self.cut = None if inner else regex.compile(rf"[{stop}]|{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" if stop
                                                    else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo = _Memo(self.count_segment)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.cut is None:
            return self.count_segment(text)
        return sum(map(self.memo.__getitem__, self.cut.findall(text)))

    def count_segment(self, s: str) -> int:
        """Best path's piece count: state per end position is (score, pieces, ends in an unknown run).

        A path looks back no further than the longest piece, so only that many states are kept."""
        ring = self.longest + 1
        best, count, in_unknown = [0.0] * ring, [0] * ring, [False] * ring
        matches = iter(self.matcher.iter(s)) if len(self.matcher) else iter(())
        last, found = next(matches, (-1, None))
        for end in range(1, len(s) + 1):
            ending = []
            while last == end - 1:
                ending.append(found)
                last, found = next(matches, (-1, None))
            top = None
            single = False
            for size, score in sorted(ending, reverse=True):  # ascending start: a tie keeps the longest
                single |= size == 1
                total = best[(end - size) % ring] + score
                if top is None or total > top:
                    top, pieces, unknown = total, count[(end - size) % ring] + 1, False
            if not single:
                before = (end - 1) % ring
                total = best[before] + self.unknown
                if top is None or total > top:
                    if self.byte_fallback:
                        pieces = count[before] + len(s[end - 1].encode("utf-8"))
                    else:
                        pieces = count[before] + (0 if in_unknown[before] else 1)
                    top, unknown = total, True
            at = end % ring
            best[at], count[at], in_unknown[at] = top, pieces, unknown
        return count[len(s) % ring]


@lru_cache(maxsize=2)
def _counter(data: bytes) -> Counter:
    return Counter(*read_pieces(data))


def count_tokens(docs: DataFrame, model_file: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``n_tokens`` (long) of every whole ``text``."""
    spark = docs.sparkSession
    text_batches(spark)
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def n_tokens(text: pa.Array) -> pa.Array:
        counter = _counter(shared.value)
        return pa.array([counter.count(t) for t in strings(text)], type=pa.int64())

    return docs.select(*keep, n_tokens(F.col("text")).alias("n_tokens"))
