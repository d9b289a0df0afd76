"""Column -> Column functions (native Spark expressions, no Python UDFs)."""
from .text import (  # noqa: F401
    delete_newlines, replace_outside, remove_emojis, keep_only, drop_chars,
    tokenize, remove_stop_words, clean_book, clean_comment, is_empty,
)
from .timefmt import (  # noqa: F401
    format_elapsed, split_minutes_seconds, format_count, format_percent, format_decimal,
)
from .scoring import argmax, cross_entropy, to_double_array  # noqa: F401
