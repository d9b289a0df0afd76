"""Character sets as code-point intervals, rendered as regex classes.

Java regex evaluates a *negated* class that holds non-ASCII ranges an order of
magnitude slower than the equivalent *positive* class of the complement, so
the cleaners match "everything outside the keep set" with the explicit
complement. Both renderings use ``\\x{...}``, read the same by Java and RE2.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

MAX_CP = 0x10FFFF


def _fmt(lo: int, hi: int) -> str:
    return f"\\x{{{lo:04X}}}" if lo == hi else f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}"


def _merge(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


@dataclass(frozen=True)
class CharSet:
    ranges: tuple[tuple[int, int], ...]

    def union(self, *chars: str | int) -> "CharSet":
        cps = [c if isinstance(c, int) else ord(c) for c in chars]
        return CharSet(tuple(_merge(list(self.ranges) + [(c, c) for c in cps])))

    def members(self) -> str:
        """Body of a class listing the set, e.g. ``\\x{0041}-\\x{005A}``."""
        return "".join(_fmt(lo, hi) for lo, hi in _merge(self.ranges))

    def complement_class(self) -> str:
        """Positive class of every code point outside the set."""
        gaps, nxt = [], 0
        for lo, hi in _merge(self.ranges):
            if lo > nxt:
                gaps.append((nxt, lo - 1))
            nxt = hi + 1
        if nxt <= MAX_CP:
            gaps.append((nxt, MAX_CP))
        return "[" + "".join(_fmt(lo, hi) for lo, hi in gaps) + "]"


def as_charset(keep) -> CharSet:
    if isinstance(keep, CharSet):
        return keep
    return CharSet(tuple(keep))
