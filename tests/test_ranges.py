"""Large quoted files in ranges: the rows of the whole-file reader, whatever the range size."""
import csv
import random

import pytest
from pyspark.sql import functions as F

from lexiframe.sources import read_csv_header, write_csv
from lexiframe.sources.ranges import pieces_of, read_csv_ranges, records

TEXTS = ["", None, "plain", "two\nlines", 'q "x" y', "a\r\nb\rc\n\n\nd", "\\N", "a,b\tc", '"', '""\n"', "\n", "é\U0001f600\n" * 40,
         "long\n" * 700, "no newline " * 300, "\r\n", "ends in cr\r"]
SCHEMA = "k long, t string, u string"


@pytest.fixture()
def small_ranges(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(c, str(n)) for c in before]
    for c, v in before.items():
        spark.conf.set(c, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_own_files_in_ranges_of_many_sizes(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    rows = [(i, rng.choice(TEXTS), rng.choice(TEXTS)) for i in range(60)]
    write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "a"))
    for size in (700, 1 << 27):
        small_ranges(size)
        got = read_csv_ranges(spark, str(tmp_path / "a"), SCHEMA)
        assert rows_of(got) == sorted(rows, key=str)
    small_ranges(2000)
    tasks = records(spark, str(tmp_path / "a")).where("text <> ''").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 8  # one file, many tasks
    assert rows_of(read_csv_header(spark, str(tmp_path / "a"), SCHEMA)) == sorted(rows, key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_external_files_and_several_of_them(spark, tmp_path, small_ranges, end):
    rng = random.Random(6)
    for n, name in enumerate(("x.csv", "y.csv")):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["k", "a long\nheader " * 30, "u"])
            for i in range(30):
                out.writerow([n * 100 + i, rng.choice(["p", "x\ny", 'say "hi"\n\n', "z" * 300, ""]), "w"])
    small_ranges(400)
    got = rows_of(read_csv_ranges(spark, str(tmp_path), SCHEMA, empty_is_null=True))
    want = []
    for name in ("x.csv", "y.csv"):
        with open(tmp_path / name, newline="", encoding="utf-8") as f:
            want += [(int(k), t or None, u) for k, t, u in list(csv.reader(f))[1:]]
    assert got == sorted(want, key=str)
    assert len(got) == 60


def test_no_rows_and_an_open_quote(spark, tmp_path):
    (tmp_path / "e.csv").write_text("k,t,u\n")
    assert read_csv_ranges(spark, str(tmp_path / "e.csv"), SCHEMA).collect() == []
    (tmp_path / "o.csv").write_text('k,t,u\n1,"open\nto the end,\n')
    texts = [r["text"] for r in records(spark, str(tmp_path / "o.csv")).collect()]
    assert sorted(texts) == ['1,"open\nto the end,', "k,t,u"]


def test_pieces_of_ranges_by_hand():
    import pyarrow as pa
    lines = [(0, 'a,"b'), (0, "c"), (9, "d"), (18, 'e"'), (18, "f"), (18, '"g')]
    batch = pa.RecordBatch.from_pylist([{"file": 1, "start": s, "quotes": v.count('"'), "value": v} for s, v in lines])
    inside = {0: False, 9: True, 18: True}
    assert list(pieces_of([batch], lambda f, s: inside[s])) == [
        (1, 0, "tail", True, 'a,"b\nc'), (1, 9, "middle", False, "d"), (1, 18, "head", False, 'e"'), (1, 18, "whole", False, "f"),
        (1, 18, "tail", False, '"g')]
