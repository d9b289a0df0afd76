"""The cleaners and scorers as SQL functions (``CREATE TEMPORARY FUNCTION ...
RETURN <expr>``). They are SQL-bodied, so Catalyst inlines them: no Python
runs per row."""
from __future__ import annotations

from pyspark.sql import SparkSession

from .charsets import CharSet, as_charset
from .constants import BENGALI_RANGES, DANDA_CP, DEFAULT_DROP_CLASS, PY_WHITESPACE
from .text import emoji_pattern


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_sql_functions(spark: SparkSession, keep: CharSet = CharSet(BENGALI_RANGES),
                           stop: list[str] | None = None, prefix: str = "") -> list[str]:
    """Register ``{prefix}t1_delete_newlines``, ``t2_replace_outside``,
    ``t3_remove_emojis``, ``t4_keep_only``, ``t5_drop_chars``, ``t7_remove_stop``,
    ``t8_clean_book``, ``t9_clean_comment``, ``a3_argmax``; return their names."""
    keep = as_charset(keep)
    stop_arr = "array(" + ", ".join(_lit(w) for w in (stop or [])) + ")"
    ws = PY_WHITESPACE.replace("\\", "\\\\") + "+"
    defs = {
        "t1_delete_newlines": "(x STRING) RETURNS STRING RETURN regexp_replace(x, '\\n', '')",
        "t2_replace_outside": f"(x STRING) RETURNS STRING RETURN regexp_replace(x, {_lit(keep.complement_class())}, ' ')",
        "t3_remove_emojis": f"(x STRING) RETURNS STRING RETURN regexp_replace(x, {_lit(emoji_pattern())}, '')",
        "t4_keep_only": ("(x STRING) RETURNS STRING RETURN trim(regexp_replace(x, "
                         f"{_lit(keep.union('.', DANDA_CP, ' ').complement_class())}, ''))"),
        "t5_drop_chars": f"(x STRING) RETURNS STRING RETURN regexp_replace(x, {_lit(DEFAULT_DROP_CLASS)}, '')",
        "t6_tokenize": f"(x STRING) RETURNS ARRAY<STRING> RETURN filter(split(x, '{ws}'), t -> t <> '')",
        "t7_remove_stop": (f"(x STRING) RETURNS STRING RETURN array_join(filter(split(x, ' '), "
                           f"t -> t <> '' AND NOT array_contains({stop_arr}, t)), ' ')"),
        "t8_clean_book": (f"(x STRING) RETURNS STRING RETURN "
                          f"{prefix}t7_remove_stop({prefix}t2_replace_outside({prefix}t1_delete_newlines(x)))"),
        "t9_clean_comment": (f"(x STRING) RETURNS STRING RETURN "
                             f"{prefix}t5_drop_chars({prefix}t4_keep_only({prefix}t3_remove_emojis(x)))"),
        "a3_argmax": "(x ARRAY<DOUBLE>) RETURNS INT RETURN array_position(x, array_max(x)) - 1",
    }
    names = []
    for name, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
        names.append(prefix + name)
    return names
