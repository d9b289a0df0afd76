"""Readers for the corpus file layouts (S1-S7). Explicit schemas, no inference."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PY_WHITESPACE
from .writers import LIKE_MARK, NULL_MARK

LABELLED_SCHEMA = "Data string, Sentiment int"


def read_delimited(spark: SparkSession, path: str, names: tuple[str, ...] = ("Data",), sep: str = "\t",
                   multi_line: bool = True, empty_is_null: bool = False) -> DataFrame:
    """Header-less delimited file; fields bound to ``names`` from the left, quotes
    removed, further fields dropped, blank lines skipped."""
    schema = ", ".join(f"{n} string" for n in names)
    return _csv(spark, schema, path, header=False, multi_line=multi_line, sep=sep, empty_is_null=empty_is_null)


def _csv(spark: SparkSession, schema: str, path: str, header: bool = True, multi_line: bool = True, sep: str = ",",
         empty_is_null: bool = False) -> DataFrame:
    """One CSV table.

    By default the dialect of the writers (K1, K2): ``\\N`` is NULL and an empty
    field an empty text. ``empty_is_null`` reads external files as pandas does:
    an empty field is NULL. ``multi_line`` (quoted fields holding newlines) makes
    every file one task, since a record boundary cannot be found from an
    arbitrary byte offset; the writers emit one part file per partition, so
    their round trips stay parallel. Pass ``multi_line=False`` for newline-free
    files to let Spark split large files."""
    reader = (spark.read.schema(schema).option("header", header).option("multiLine", multi_line).option("sep", sep)
              .option("escape", '"').option("enforceSchema", True))
    if empty_is_null:
        return reader.csv(path)
    df = reader.option("nullValue", NULL_MARK).option("emptyValue", "").csv(path)
    return df.withColumns({c: F.when(F.col(c).rlike(LIKE_MARK), F.expr(f"substring(`{c}`, 2)")).otherwise(F.col(c))
                           for c, t in df.dtypes if t == "string"})


def read_csv_header(spark: SparkSession, path: str, schema: str = LABELLED_SCHEMA,
                    multi_line: bool = True, empty_is_null: bool = False) -> DataFrame:
    """CSV with a header row; quoted fields may hold newlines and doubled quotes."""
    return _csv(spark, schema, path, multi_line=multi_line, empty_is_null=empty_is_null)


def read_csv_indexed(spark: SparkSession, path: str, schema: str = LABELLED_SCHEMA, keep_index: bool = True,
                     multi_line: bool = True, empty_is_null: bool = False) -> DataFrame:
    """CSV whose first column is a stored row index; kept as ``row_id`` or dropped."""
    df = _csv(spark, "_idx long, " + schema, path, multi_line=multi_line, empty_is_null=empty_is_null)
    return df.withColumnRenamed("_idx", "row_id") if keep_index else df.drop("_idx")


def read_review_table(spark: SparkSession, path: str, fmt: str = "parquet",
                      text_col: str = "Review") -> DataFrame:
    """The review sheet exported to Parquet or CSV, text column renamed to ``Data``."""
    if fmt == "csv":
        df = read_csv_indexed(spark, path, f"{text_col} string, Sentiment int")
    else:
        df = spark.read.parquet(path).withColumnRenamed("_idx", "row_id")
    return df.withColumnRenamed(text_col, "Data")


def read_positional_csv(spark: SparkSession, path: str,
                        fields: tuple[str, ...] = ("text", "labels"), empty_is_null: bool = False) -> DataFrame:
    """Fields bound by position (header row skipped, its names ignored), all strings."""
    return _csv(spark, ", ".join(f"{f} string" for f in fields), path, empty_is_null=empty_is_null)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated words of a text file (CRLF absorbed) -> ``word`` rows.

    Its row count is the list size; the order of the rows carries no meaning.
    """
    lines = spark.read.text(path)
    words = lines.select(F.posexplode(F.split("value", PY_WHITESPACE + "+")).alias("pos", "word"))
    return words.where(F.col("word") != "").select("word")


def read_partitioned(spark: SparkSession, path: str, **equals) -> DataFrame:
    """A table partitioned by key columns (results by model, classes and dataset; a corpus by
    dataset, variant and split); equality filters prune partitions."""
    df = spark.read.parquet(path)
    for k, v in equals.items():
        df = df.where(F.col(k) == F.lit(v))
    return df
