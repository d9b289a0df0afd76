"""Token look-ups in Arrow batches against a vocabulary of a checked size.

The flat value buffer of a list column is looked up in one vectorised call per
batch and the list offsets are kept, so a row's tokens never leave their row:
no explode, no shuffle, no regrouping. Of a larger vocabulary the part with the
smallest ids (:func:`hot_part`; the most frequent tokens, as ``build_vocab``
numbers them) is looked up this way, and only the entries that it lacks are
joined by shuffle and put back at their places (:func:`gaps`).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_TOKENS = 6_000_000
BROADCAST_BYTES = 64 << 20
HOT_TOKENS = 4_000_000  # entries of a larger vocabulary that are sent to the tasks


def small_table(df: DataFrame, token: str, *more: str) -> pa.Table | None:
    """The columns of ``df`` if their rows and text bytes are within the limits
    (measured first), else None: the caller takes its shuffled path."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(token))).first()
    if n > BROADCAST_TOKENS or (size or 0) > BROADCAST_BYTES:
        return None
    return df.select(token, *more).toArrow().combine_chunks()


def hot_part(vocab: DataFrame, token: str, number: str) -> tuple[int | None, pa.Table]:
    """(largest id, columns) of the part of ``vocab`` with the smallest ids, about ``HOT_TOKENS`` rows and within
    ``BROADCAST_BYTES`` (both measured); (None, no rows) if there is none. The rest has larger ids."""
    n = vocab.agg(F.count(number)).first()[0]
    share = min(1.0, HOT_TOKENS / max(n, 1))
    while n and share * n >= 1:
        bound = vocab.agg(F.percentile_approx(number, share)).first()[0]
        part = vocab.where(F.col(number) <= bound)
        rows, size = part.agg(F.count(F.lit(1)), F.sum(F.octet_length(token))).first()
        if rows <= 2 * HOT_TOKENS and (size or 0) <= BROADCAST_BYTES:
            return bound, part.select(token, number).toArrow().combine_chunks()
        share /= 4
    return None, vocab.limit(0).select(token, number).toArrow().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values of all rows end to end, row lengths with 0 for null rows, which rows are not null)."""
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    values = lists.flatten()  # skips null rows
    lengths = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    return values, lengths, valid


def lists_of(values: pa.Array, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~valid))


def heads(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's first ``most`` values in the flat values, and the new lengths."""
    kept = np.minimum(lengths, most)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(kept)), kept)
    return np.arange(kept.sum()) - (np.cumsum(kept) - kept)[row] + starts[row], kept


def packed(ids: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of ids as lists of bytes: an id takes one to five, 7 bits in each, the lowest first, the last one below 128. The
    most frequent tokens have the smallest ids, so rows that are written or moved take half the bytes of int lists."""
    numbers = ids.astype(np.int32).view(np.uint32)
    sizes = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        long = sizes > k
        out[ends[:-1][long] + k] = (numbers[long] >> 7 * k & 127) | np.where(sizes[long] > k + 1, 128, 0)
    rows = np.concatenate([[0], np.cumsum(lengths)])
    return lists_of(pa.array(out.view(np.int8)), np.diff(ends[rows]), valid)


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all rows end to end, row lengths, which rows are not null) of :func:`packed` rows."""
    values, sizes, valid = flat(lists)
    data = values.to_numpy(zero_copy_only=False).view(np.uint8)
    last = data < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends])[:-1]
    numbers = np.zeros(len(ends), np.uint32)
    for k in range(int((ends - starts).max(initial=0))):
        long = ends - starts > k
        numbers[long] |= (data[starts[long] + k] & 127).astype(np.uint32) << 7 * k
    before = np.concatenate([[0], np.cumsum(last)])
    rows = np.concatenate([[0], np.cumsum(sizes)])
    return numbers.view(np.int32), np.diff(before[rows]), valid


def gaps(missing: np.ndarray, lengths: np.ndarray, at: pa.Array) -> np.ndarray:
    """Places in the flat values that rows' entries fill: ``missing`` marks the open places, ``lengths`` are the rows'
    lengths, ``at`` lists per row the numbers of its open places, from 0, that its entries belong to."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    each = np.bincount(row[missing], minlength=len(lengths))
    numbers, entries, _ = flat(at)
    return np.flatnonzero(missing)[np.repeat(np.cumsum(each) - each, entries) + numbers.to_numpy(zero_copy_only=False)]


class TokenTable:
    """token -> id. A look-up hashes the distinct tokens of its batch and runs the table past them: a worker holds the
    table's text and ids, and no hash table of its size."""

    _known = None  # nothing is kept from one look-up to the next

    def __init__(self, tokens: pa.Array, ids: np.ndarray):
        self.tokens, self.ids = tokens, np.asarray(ids, np.int32)

    def ids_of(self, tokens: pa.Array, unknown: int) -> np.ndarray:
        """Ids of ``tokens``; a token that is not in the table, or NULL, gives ``unknown``."""
        coded = tokens.dictionary_encode()
        words = coded.dictionary.cast(self.tokens.type)
        at = pc.index_in(self.tokens, value_set=words, skip_nulls=True)  # of each table entry, its place among the words
        hit = at.is_valid()
        of = np.full(len(words) + 1, unknown, np.int32)
        of[at.filter(hit).to_numpy()] = self.ids[hit.to_numpy(zero_copy_only=False)]
        return of[coded.indices.fill_null(len(words)).to_numpy()]


class IdTable:
    """id -> name by binary search over ids that a worker sorts once."""

    def __init__(self, ids: np.ndarray, names: pa.Array):
        self.ids, self.names, self._order = np.asarray(ids, np.int32), names, None

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "names": self.names, "_order": None}

    def names_of(self, ids: pa.Array) -> pa.Array:
        """Names of ``ids``; NULL for an id that is not in the table, or NULL."""
        if self._order is None:
            self._order = np.argsort(self.ids, kind="stable")
            self._sorted = self.ids[self._order]
        wanted = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self._sorted, wanted), max(len(self._sorted) - 1, 0))
        if not len(self._sorted):
            return pa.nulls(len(wanted), pa.string())
        found = (self._sorted[at] == wanted) & ids.is_valid().to_numpy(zero_copy_only=False)
        return self.names.take(pa.array(self._order[at], mask=~found))
