"""Structured Streaming entry points for the stateless cleaners and the
streaming label counts."""
from .stream import clean_comment_stream, label_counts_stream, run_available  # noqa: F401
