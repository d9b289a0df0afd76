"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Each match of the split pattern is encoded by itself. Its bytes are mapped to
Latin-1 characters so that an Aho-Corasick automaton over the vocabulary lists
every token that starts at every position. Starting with the longest token, a
token is kept when it is compatible with the one before it: BPE, run on the
two tokens' bytes, yields exactly this pair. If no token fits, the position is
marked dead and the previous token is shortened. A position is marked dead at
most once, so the work is linear in the matches, and a sequence whose adjacent
pairs are all compatible is the one that the merges produce.

Compatibility of a pair is memoised, and so are encoded pieces (bounded tables
in each Python worker). The rank file is read on the driver (under 1 MB) and
broadcast. Tokens that merges never produce are not matched; like the public
library, a piece that is itself in the vocabulary is that token.

Defined results: a null text counts as empty; an empty text has no ids; a
repeated row is encoded again; lone decoding of ids gives the exact bytes.
"""
from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, text_batches

MEMO_PIECES = 400_000  # pieces a worker remembers before it starts afresh
MEMO_PAIRS = 1_000_000
MEMO_PIECE_CHARS = 64  # longer pieces are not remembered


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank of a file of ``base64 rank`` lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines() if data else ())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """Plain BPE: merge the lowest-ranked adjacent pair until none is left (ranks under ``below``)."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Memo(dict):
    """piece text -> ids as little-endian bytes; filled on first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.encode(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= MEMO_PIECE_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = out
        return out


@dataclass
class Codec:
    """Encoder and decoder of one vocabulary."""
    ranks: dict[bytes, int]
    pattern: str
    parts: dict[int, tuple[int, int]] = field(default_factory=dict)  # token -> the two ids it merges from
    pairs: dict[tuple[int, int], bool] = field(default_factory=dict)

    def __post_init__(self):
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if len(token) > 1:
                halves = merge_bytes(token, self.ranks, rank)
                if len(halves) != 2:
                    continue  # merges never produce it
                pair = (self.ranks[halves[0]], self.ranks[halves[1]])
                self.parts[rank] = pair
                self.merged[pair] = rank
            self.matcher.add_word(token.decode("latin-1"), (len(token), rank))
        if len(self.matcher):
            self.matcher.make_automaton()
        self.split = regex.compile(self.pattern)
        self.memo = _Memo(self.encode_piece)
        size = max(self.bytes_of, default=-1) + 1
        table = [self.bytes_of.get(i, b"") for i in range(size)]
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in table])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of ``left`` then ``right`` ends in this pair.

        The last merges are undone from both sides of the border, the later
        rank first; a merge across the border that comes before the one just
        undone would have been taken instead."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, bound, fits = left, right, float("inf"), True
        while True:
            if self.merged.get((a, b), bound) < bound:
                fits = False
                break
            # equal ranks merge left to right, so the right one is undone first on a tie
            undo_left = a in self.parts and (a > b or b not in self.parts)
            if undo_left:
                bound, a = a, self.parts[a][1]
            elif b in self.parts:
                bound, b = b + 1, self.parts[b][0]
            else:
                break
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        starting: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (size, rank) in self.matcher.iter(piece.decode("latin-1")):
            starting[end + 1 - size].append((size, rank))  # ends ascend, so sizes ascend
        alive = [True] * (len(piece) + 1)
        out: list[tuple[int, int]] = []
        next_try: list[int] = []  # per kept token: the index of its shorter alternative
        at, i = 0, len(starting[0]) - 1 if piece else -1
        while at < len(piece):
            while i >= 0:
                size, rank = starting[at][i]
                if alive[at + size] and (not out or self.compatible(out[-1][1], rank)):
                    break
                i -= 1
            if i >= 0:
                out.append((size, rank))
                next_try.append(i)
                at += size
                i = len(starting[at]) - 1 if at < len(piece) else -1
            else:
                if not out:
                    raise ValueError("the vocabulary does not hold every byte")
                alive[at] = False
                at -= out.pop()[0]
                i = next_try.pop()
        return [rank for _, rank in out]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from the vocabulary in blocks."""
        out = []
        for a in range(0, len(ids), 1 << 18):
            block = ids[a:a + (1 << 18)].astype(np.int64)
            start, size = self.starts[block], self.starts[block + 1] - self.starts[block]
            before = np.cumsum(size) - size
            out.append(self.blob[np.repeat(start - before, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _codec(data: bytes, pattern: str) -> Codec:
    return Codec(parse_ranks(data), pattern)


def read_rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, rank_file: str, pattern: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``ids`` (array<long>) of every whole ``text``."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(read_rank_file(rank_file))

    @F.arrow_udf("array<long>")
    def ids(text: pa.Array) -> pa.Array:
        codec = _codec(shared.value, pattern)
        packed = [codec.encode(t) for t in strings(text)]
        ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int64)))

    return docs.select(*keep, ids(F.col("text")).alias("ids"))


def decode(encoded: DataFrame, rank_file: str, pattern: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``data`` (binary) decoded from ``ids`` (null as empty)."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_rank_file(rank_file))

    @F.arrow_udf("binary")
    def data(ids: pa.Array) -> pa.Array:
        codec = _codec(shared.value, pattern)
        return pa.array([codec.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64)) for x in ids],
                        type=pa.binary())

    return encoded.select(*keep, data(F.col("ids")).alias("data"))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, *keep: str, with_ids: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text, and ``ids`` on request.

    Encoding and decoding run in one pass."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(read_rank_file(rank_file))
    fields = "n_tokens: long, ids_sha256: string, decoded_sha256: string" + (", ids: array<int>" if with_ids else "")

    @F.arrow_udf(f"struct<{fields}>")
    def digest(text: pa.Array) -> pa.Array:
        codec = _codec(shared.value, pattern)
        packed = [codec.encode(t) for t in strings(text)]
        sizes = [len(p) // 4 for p in packed]
        out = [pa.array(sizes, type=pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], type=pa.string()),
               pa.array([hashlib.sha256(codec.decode(np.frombuffer(p, "<u4"))).hexdigest() for p in packed], type=pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            out.append(pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32),
                                                pa.array(np.frombuffer(b"".join(packed), "<i4"))))
            names.append("ids")
        return pa.StructArray.from_arrays(out, names=names)

    return docs.select(*keep, digest(F.col("text")).alias("__d")).select(*keep, "__d.*")
