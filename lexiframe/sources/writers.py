"""Sinks (K1-K4)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_MARK = r"\N"
# a text that reads like the mark (backslashes, then N) gets one more backslash on the way out
LIKE_MARK = r"^\\+N$"


def guard_marks(df: DataFrame) -> DataFrame:
    """Keep texts that equal the NULL mark apart from NULL."""
    return df.withColumns({c: F.when(F.col(c).rlike(LIKE_MARK), F.concat(F.lit("\\"), F.col(c))).otherwise(F.col(c))
                           for c, t in df.dtypes if t == "string"})


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True, sep: str = ",") -> None:
    """K1: CSV, no index. All fields quoted, quotes doubled, newlines and outer
    white space kept; NULL is written as ``\\N``, so empty texts stay empty."""
    (guard_marks(df).write.mode(mode).option("header", header).option("sep", sep).option("escape", '"')
     .option("quoteAll", True).option("nullValue", NULL_MARK).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_csv_indexed(df: DataFrame, path: str, index: str = "row_id", mode: str = "overwrite") -> None:
    """K2: CSV with the row index as the first column."""
    cols = [index] + [c for c in df.columns if c != index]
    write_csv(df.select(*cols).withColumnRenamed(index, "_idx"), path, mode)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = ("model", "classes", "dataset"),
                      fmt: str = "parquet") -> None:
    """K3 / K4: results under a (model, class variant, dataset) key as partition
    columns; dynamic overwrite replaces only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).format(fmt).save(path))
