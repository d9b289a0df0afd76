"""Text cleaners as native column expressions.

Every function maps a ``Column`` (or column name) to a ``Column`` built from
``regexp_replace`` / ``split`` / ``filter`` / ``array_join``; Catalyst folds a
chain of them into one projection inside whole-stage codegen. NULL in gives
NULL out; empty strings are kept.

Patterns use ``\\x{...}`` and ``\\p{...}`` only, which Java regex and RE2 read
the same way, so the same pattern text can be used in a SQL oracle.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charsets import CharSet, as_charset
from .constants import (
    BENGALI_RANGES, BOOK_STOP_WORDS, DANDA_CP, DEFAULT_DROP_CLASS, EMOJI_CLASS_ENTRIES,
    PY_WHITESPACE,
)

BENGALI = CharSet(BENGALI_RANGES)

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def delete_newlines(c: ColumnLike) -> Column:
    """Delete line feeds without inserting a space (glues the words)."""
    return F.regexp_replace(_c(c), "\n", "")


def replace_outside(c: ColumnLike, keep: CharSet = BENGALI) -> Column:
    """Replace every character outside ``keep`` by one space, 1:1, no collapsing."""
    return F.regexp_replace(_c(c), as_charset(keep).complement_class(), " ")


def emoji_pattern() -> str:
    return "[" + "".join(EMOJI_CLASS_ENTRIES) + "]+"


def remove_emojis(c: ColumnLike) -> Column:
    """Delete runs of emoji, symbols, pictographs and supplementary-plane characters."""
    return F.regexp_replace(_c(c), emoji_pattern(), "")


def keep_only(c: ColumnLike, keep: CharSet = BENGALI, extra: str = "." + chr(DANDA_CP) + " ",
              collapse_spaces: bool = False) -> Column:
    """T4 / F2: keep ``keep`` plus ``extra`` (full stop, danda, space), delete the rest, trim.

    The original cleaner computes a space-collapsed string and discards it, so
    inner runs of spaces survive; ``collapse_spaces=True`` applies the collapse.
    """
    out = F.regexp_replace(_c(c), as_charset(keep).union(*extra).complement_class(), "")
    if collapse_spaces:
        out = F.regexp_replace(out, " +", " ")
    return F.trim(out)


def drop_chars(c: ColumnLike, chars: Iterable[str] | None = None,
               pattern: str = DEFAULT_DROP_CLASS) -> Column:
    """T5: delete digits, operators, punctuation and other marks.

    ``chars`` (an explicit character list) wins over ``pattern`` (a regex class).
    """
    if chars is not None:
        chars = "".join(chars)
        return F.translate(_c(c), chars, "") if chars else _c(c)
    return F.regexp_replace(_c(c), pattern, "")


def tokenize(c: ColumnLike, spaces_only: bool = False) -> Column:
    """Whitespace tokenise like Python's ``str.split()`` (blank -> empty array).

    ``spaces_only`` splits on the space character alone, which is exact after
    T2 (it has mapped every other whitespace character to a space) and cheaper.
    """
    sep = " " if spaces_only else PY_WHITESPACE + "+"
    return F.filter(F.split(_c(c), sep), lambda t: t != "")


def _not_stop(stop: list[str]):
    if not stop:
        return None
    return lambda t: ~t.isin(stop)


def remove_stop_words(c: ColumnLike, stop: Iterable[str] = BOOK_STOP_WORDS,
                      spaces_only: bool = False) -> Column:
    """Tokenise, drop tokens found in ``stop`` (exact match), re-join with one space.

    Order and duplicates are kept (``array_except`` would de-duplicate). A list
    above ten entries compiles to a hash-set membership test (``InSet``).
    For stop lists too large to inline use
    :func:`lexiframe.operators.shape.remove_stop_words_table`.
    """
    stop = list(dict.fromkeys(stop))
    toks = tokenize(c, spaces_only)
    pred = _not_stop(stop)
    if pred is not None:
        toks = F.filter(toks, pred)
    return F.array_join(toks, " ")


def clean_book(c: ColumnLike, keep: CharSet = BENGALI,
               stop: Iterable[str] = BOOK_STOP_WORDS) -> Column:
    """Book-review cleaner = T1 -> T2 -> T7 (T5 is applied later by the caller).

    ``keep`` must not contain whitespace, so T2 leaves spaces as the only separator.
    """
    return remove_stop_words(replace_outside(delete_newlines(c), keep), stop, spaces_only=True)


def clean_comment(c: ColumnLike, keep: CharSet = BENGALI,
                  chars: Iterable[str] | None = None, pattern: str = DEFAULT_DROP_CLASS) -> Column:
    """Comment cleaner = T3 -> T4 -> T5."""
    return drop_chars(keep_only(remove_emojis(c), keep), chars, pattern)


def is_empty(c: ColumnLike) -> Column:
    """true when nothing but spaces is left (NULL stays NULL)."""
    return F.length(F.trim(_c(c))) == 0


def tokenize_regex(c: ColumnLike, pattern: str = r"\p{L}+") -> Column:
    """E1 (regex form): every match of ``pattern`` is a token (``regexp_extract_all``)."""
    return F.regexp_extract_all(_c(c), F.lit(pattern), 0)
