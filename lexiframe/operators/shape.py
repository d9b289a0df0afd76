"""Projections, unions, the index-aligned join, filters and profiles (P*, U*, F*)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import lookup as L
from .ranking import ordered_index, with_row_ids


def add_label(df: DataFrame, value: int, name: str = "Sentiment") -> DataFrame:
    """Constant label column (the label comes from which file a row was read from)."""
    return df.withColumn(name, F.lit(int(value)).cast("int"))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(dict(mapping))


def drop(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns."""
    return df.drop(*cols)


def project(df: DataFrame, text: str = "Data", label: str = "Sentiment", *keys: str) -> DataFrame:
    """Keep key columns, the text and the label."""
    return df.select(*keys, text, label)


def recode(df: DataFrame, mapping: Mapping[int, int], col: str = "Sentiment") -> DataFrame:
    """Recode label values simultaneously (a swap stays a swap, not a chain)."""
    return df.replace(dict(mapping), subset=[col])


def drop_class(df: DataFrame, value: int, col: str = "Sentiment") -> DataFrame:
    """remove one class (the two-class variant drops the neutral rows)."""
    return df.where(F.col(col) != F.lit(value))


def union_corpora(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name, keeping duplicates (UNION ALL)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def renumber(df: DataFrame, order_cols: Sequence[str], part_col: str | None = None,
             name: str = "row_id", positions: Sequence[int] | None = None) -> DataFrame:
    """Number rows 0..n-1 in ``(part_col, *order_cols)`` order (the tuple
    must be unique). Range partitions on the whole tuple keep every task about
    the same size, whatever the key distribution. With ``positions`` only
    those rows are returned (P8)."""
    order = ([part_col] if part_col else []) + list(order_cols)
    return ordered_index(df, order, name=name, positions=positions)


def index_aligned_join(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Re-attach columns by row key; an outer join like index alignment.

    The full outer join is written as a left join (every left row) plus the
    right rows without a partner (an anti join against the left *keys* only).
    Spark picks the join by size: a small label side is broadcast and the wide
    left side not shuffled; otherwise both are shuffle joins of a kind AQE can
    split when one key holds a large share of the rows (a full outer join
    cannot be split).
    """
    matched = left.join(right, on=key, how="left")
    orphans = right.join(left.select(key), on=key, how="left_anti")
    return matched.unionByName(orphans, allowMissingColumns=True)


def row_at(df: DataFrame, position: int, order_cols: Sequence[str], name: str = "pos") -> DataFrame:
    """The row at 0-based ``position`` in key order (``iloc``); only the
    key columns are ranked, and the one wanted key is joined back by broadcast."""
    return renumber(df, order_cols, name=name, positions=[position])


def head(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """First ``n`` rows in key order (a top-k plan, no global sort)."""
    return df.orderBy(*order_cols).limit(n)


def shape(df: DataFrame, split_col: str | None = None) -> DataFrame:
    """P10: row count (per split when given) and column count."""
    g = df.groupBy(split_col) if split_col else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column its type and non-null count, in one aggregate pass."""
    aggs = [F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    stacked = ", ".join(
        f"'{c}', '{t}', _nn{i}" for i, (c, t) in enumerate(df.dtypes))
    return row.selectExpr(
        f"stack({len(df.columns)}, {stacked}) AS (column_name, dtype, non_null)", "_n AS n_rows"
    ).withColumn("non_null", F.col("non_null").cast("long")).withColumn("n_rows", F.col("n_rows").cast("long"))


def attach_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """The same run constants on every row (literal columns, no join)."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once (empty when the key is a valid index)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unpivot_series(df: DataFrame, key: str, series: Sequence[str],
                   names: tuple[str, str] = ("series", "value")) -> DataFrame:
    """Wide metric table -> long (key, series, value) rows."""
    return df.unpivot([key], list(series), names[0], names[1])


def remove_stop_words_table(df: DataFrame, key: str, text: Column | str, stop: DataFrame,
                            out: str = "text_nostop", word_col: str = "word", spaces_only: bool = False) -> DataFrame:
    """U4 for stop lists too large to inline. Returns ``(key, out)`` for every input row; NULL stays NULL.

    While the list is within a checked size, each Arrow batch drops its stop
    tokens in one vectorised call (no shuffle). A larger list marks exploded
    tokens by a shuffled join and regroups the others by a per-row id, so a
    repeated key never forms one large group.
    """
    text = F.col(text) if isinstance(text, str) else text
    words = stop.select(F.col(word_col).alias("_tok")).where(F.col("_tok").isNotNull()).distinct()
    table = L.small_table(words, "_tok")
    if table is not None:
        shared = df.sparkSession.sparkContext.broadcast(L.TokenTable(L.column(table, "_tok"), np.zeros(table.num_rows, np.int32)))

        @F.arrow_udf("array<string>")
        def without(lists: pa.Array) -> pa.Array:
            values, lengths, valid = L.flat(lists)
            kept = shared.value.ids_of(values, -1) < 0
            counts = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
            return L.lists_of(values.filter(pa.array(kept)), counts, valid)

        return df.select(key, F.array_join(without(tokenize(text, spaces_only)), " ").alias(out))
    rows = with_row_ids(df.select(key, text.isNull().alias("_null"), tokenize(text, spaces_only).alias("_toks")),
                        key, F.struct("_null", "_toks"))
    toks = rows.select(key, "_rid", "_null", F.posexplode_outer("_toks").alias("_pos", "_tok"))
    # a left join with a marker (not an anti join) so rows whose tokens are all stop words survive
    kept = toks.join(words.withColumn("_stop", F.lit(True)), on="_tok", how="left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("_tok").isNotNull() & F.col("_stop").isNull(), F.struct("_pos", "_tok")))),
        lambda s: s["_tok"]), " ")
    g = kept.groupBy(key, "_rid").agg(F.first("_null").alias("_null"), joined.alias(out))
    return g.select(key, F.when(F.col("_null"), F.lit(None).cast("string")).otherwise(F.col(out)).alias(out))
