"""Sources (S1-S7) and sinks (K1-K4)."""
from .readers import (  # noqa: F401
    read_delimited, read_csv_header, read_csv_indexed, read_positional_csv, read_stop_words,
    read_partitioned, read_review_table,
)
from .fields import Field, LabelField, TextField, learn_fields, read_fields  # noqa: F401
from .writers import write_csv, write_csv_indexed, write_partitioned  # noqa: F401
