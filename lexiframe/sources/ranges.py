"""S1-S4 for large quoted files: one CSV file read by many tasks although quoted fields hold newlines.

Whether a byte lies inside quotes depends on how many quotes stand before it, so a task that starts in the middle of a file cannot
tell a record border from a newline in a text. That needs one bit per range only:

1. Spark splits the file into ranges of lines; each range counts its quotes (one aggregate, partial in the tasks).
2. The parities are combined in file order: a range starts inside quotes if the ranges before it hold an odd number.
3. Each range, read again with its bit, puts its lines together to records. What stands before its first border, and what is open at
   its end, are fragments of records that cross ranges, at most two a range.
4. Fragments of one record are joined in file order. Whole records and joined ones go to Spark's own CSV expression.

Memory of a task is bounded by its longest record. The file is scanned three times (quotes, fragments, records) and only fragments
are shuffled. Ranges are those of ``spark.sql.files.maxPartitionBytes``; their bits reach the tasks as arrays while there are at
most ``MOST_RANGES`` (counted first), and more ranges raise an error: use larger ones.

Dialect: every quote opens or closes a quoted field or is doubled inside one, as the writers (K1, K2) and RFC 4180 files have it.
A file with stray quotes in unquoted fields must be read by the other readers (``multi_line=True``). Lines end in LF or CRLF; line
ends inside quotes are kept as they are. Blank lines give no record. A quote left open at a file's end gives one last record.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .writers import LIKE_MARK, NULL_MARK

MOST_RANGES = 2_000_000
FLUSH_BYTES = 8 << 20  # texts a task holds before it hands them on

_PIECES = "file long, start long, kind string, first boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order inside each partition, with the file and range they come from and their number of quotes."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("start"),
        (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"), "value")


def _range_bits(lines: DataFrame) -> pa.Table:
    """file, start, odd: whether a range starts inside quotes."""
    sums = lines.groupBy("file", "start").agg((F.sum("quotes") % 2).alias("own"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bits = sums.select("file", "start", (F.coalesce(F.sum("own").over(before), F.lit(0)) % 2).cast("int").alias("odd")).persist()
    try:
        n = bits.count()
        if n > MOST_RANGES:
            raise ValueError(f"{n} ranges, at most {MOST_RANGES}: raise spark.sql.files.maxPartitionBytes")
        return bits.toArrow()
    finally:
        bits.unpersist()


def _joined(parts: list[str], ended: bool) -> str:
    text = "\n".join(parts)
    return text[:-1] if ended and text.endswith("\r") else text


def pieces_of(batches: Iterator[pa.RecordBatch], starts_inside) -> Iterator[tuple[int, int, str, bool, str]]:
    """(file, start, kind, first, text) of a partition's lines: whole records, and the fragments at a range's ends.

    ``head`` ends a record of an earlier range, ``middle`` is a range without any border, ``tail`` begins a record that the next
    ranges go on with. ``first`` marks the first record of a file."""
    at: tuple[int, int] | None = None
    inside, borders, first, open_parts = False, False, False, []

    def end_of_range():
        if open_parts:
            yield (*at, "tail" if borders else "middle", first, _joined(open_parts, False))

    for batch in batches:
        files, starts, quotes = (batch.column(i).to_pylist() for i in range(3))
        for f, s, q, value in zip(files, starts, quotes, batch.column(3).to_pylist()):
            if (f, s) != at:
                yield from end_of_range()
                at, open_parts = (f, s), []
                inside = starts_inside(f, s)
                borders, first = not inside, s == 0
            open_parts.append(value)
            if q % 2:
                inside = not inside
            if not inside:
                yield (*at, "whole" if borders else "head", first, _joined(open_parts, True))
                open_parts, first, borders = [], False, True
    if at is not None:
        yield from end_of_range()


def records(spark: SparkSession, path: str) -> DataFrame:
    """first, text: every record of the files at ``path`` as one text; ``first`` marks the first one of each file."""
    lines = _lines(spark, path)
    bits = _range_bits(lines).sort_by([("file", "ascending"), ("start", "ascending")])
    shared = spark.sparkContext.broadcast(tuple(bits.column(c).to_numpy() for c in ("file", "start", "odd")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, starts, odd = shared.value

        def starts_inside(file: int, start: int) -> bool:
            a, b = np.searchsorted(files, file, "left"), np.searchsorted(files, file, "right")
            at = a + np.searchsorted(starts[a:b], start)
            if at == b or starts[at] != start:
                raise ValueError(f"the range at byte {start} was not counted: files or spark.sql.files settings changed since")
            return bool(odd[at])

        names, rows, size = ["file", "start", "kind", "first", "text"], [], 0

        def batch() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for piece in pieces_of(batches, starts_inside):
            rows.append(piece)
            size += len(piece[4])
            if size > FLUSH_BYTES or len(rows) >= 10_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    pieces = lines.mapInArrow(cut, _PIECES)
    whole = pieces.where("kind = 'whole'").select("first", "text")
    return whole.unionByName(_stitched(pieces.where("kind <> 'whole'")))


def _stitched(fragments: DataFrame) -> DataFrame:
    """Fragments of one record as one text. A record is named by the range that its tail fragment stands in; a file's ranges are
    numbered from narrow rows, so no task gathers the texts of a file."""
    upto = Window.partitionBy("file").orderBy("start", "late").rowsBetween(Window.unboundedPreceding, 0)
    rows = fragments.withColumn("late", (F.col("kind") == "tail").cast("int"))  # a range's head comes before its tail
    names = rows.select("file", "start", "late", F.max(F.when(F.col("kind") == "tail", F.col("start"))).over(upto).alias("record"))
    parts = rows.join(names, ["file", "start", "late"]).groupBy("file", "record").agg(
        F.bool_or("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("start", "late", "text"))).alias("parts"))
    return parts.select("first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def read_csv_ranges(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",",
                    empty_is_null: bool = False) -> DataFrame:
    """The rows of the readers of S1-S4, each file read by as many tasks as it has ranges. (With ``multi_line=True`` Spark guesses the
    line end from the first one, also if it stands inside quotes; here LF and CRLF both end a record.)"""
    found = records(spark, path).where(F.col("text") != "")
    if header:
        found = found.where(~F.col("first"))
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    if not empty_is_null:
        options |= {"nullValue": NULL_MARK, "emptyValue": ""}
    df = found.select(F.from_csv("text", schema, options).alias("r")).select("r.*")
    if empty_is_null:
        return df
    return df.withColumns({c: F.when(F.col(c).rlike(LIKE_MARK), F.expr(f"substring(`{c}`, 2)")).otherwise(F.col(c))
                           for c, t in df.dtypes if t == "string"})
