"""Word shingles as 64-bit hashes, for whole batches of texts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20  # bytes hashed at a time
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                               0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(BASE, PIECE + 1), _powers(INVERSE, PIECE + 1)


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of raw[s:e] for spans within a stretch of at most PIECE bytes."""
    p = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[:len(raw)], out=p[1:])
    return mix64((p[ends] - p[starts]) * _DOWN[starts])


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, word offsets per text). Words are runs of other than ASCII white space;
    a word over PIECE bytes is hashed in parts that are added up."""
    solid = ~SPACES[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    borders = off[:-1][off[:-1] < len(raw)]
    first[borders] = solid[borders]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = off[1:][off[1:] > 0] - 1
    if len(raw):
        last[inner] = solid[inner]
    ends = np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + PIECE, side="right"))
        if j > i:
            out[i:j] = _span_hashes(raw[a:ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
            i = j
        else:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for k, b in enumerate(range(a, ends[i], PIECE)):
                    part = raw[b:min(b + PIECE, ends[i])]
                    h += mix64(_span_hashes(part, np.array([0]), np.array([len(part)])) + np.uint64(k))[0]
            out[i] = h
            i += 1
    return out, np.searchsorted(starts, off)


def shingle_hashes(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``words``-word shingle, offsets per text); a shorter text is one shingle, none without words."""
    w, at = word_hashes(raw, off)
    n = np.diff(at)
    rolled = np.zeros(max(len(w), 1), np.uint64)
    for k in range(words):
        m = len(w) - k
        if m > 0:
            rolled[:m] += w[k:] * _ODD[k]
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    which = np.arange(ends[-1]) - ends[text] + at[text]
    out = mix64(rolled[which])
    for t in np.flatnonzero((n > 0) & (n < words)):  # short texts: their own words only
        h = np.uint64(n[t])
        with np.errstate(over="ignore"):
            for k in range(n[t]):
                h += w[at[t] + k] * _ODD[k]
        out[ends[t]] = mix64(np.array([h]))[0]
    return out, ends


def weighted_sets(raw: np.ndarray, off: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct shingles, ascending, and how often each occurs."""
    h, ends = shingle_hashes(raw, off, words)
    for a, b in zip(ends[:-1], ends[1:]):
        yield np.unique(h[a:b], return_counts=True)
