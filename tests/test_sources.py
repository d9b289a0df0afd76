"""CSV round trips keep every text as it is."""
from lexiframe.sources import read_csv_header, read_csv_indexed, read_delimited, write_csv, write_csv_indexed

TEXTS = ["  lead and trail  ", "\t tab", "", None, 'q "x" y', "a\r\nb\rc\nd", "back\\slash\\", "\\N", "\\\\N", "a,b\tc", "\\", '"',
         "é\U0001f600", " ", "#c", "null", "NaN"]


def test_own_dialect_round_trip(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "row_id long, t string").repartition(3)
    write_csv(df, str(tmp_path / "a"))
    assert sorted(map(tuple, read_csv_header(spark, str(tmp_path / "a"), "row_id long, t string").collect())) == rows
    write_csv_indexed(df, str(tmp_path / "b"))
    assert sorted(map(tuple, read_csv_indexed(spark, str(tmp_path / "b"), "t string").collect())) == rows
    write_csv(df.select("t"), str(tmp_path / "c"), header=False, sep="\t")
    assert sorted(str(r[0]) for r in read_delimited(spark, str(tmp_path / "c")).collect()) == sorted(map(str, TEXTS))


def test_external_files_as_pandas_reads_them(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,t\n1,"quoted, text"\n2,\n3,""\n', encoding="utf-8")
    got = read_csv_header(spark, str(tmp_path / "x.csv"), "k long, t string", empty_is_null=True).collect()
    assert [tuple(r) for r in got][:2] == [(1, "quoted, text"), (2, None)]
    (tmp_path / "x.tsv").write_text('"quoted text"\na\tb\n\nplain\n', encoding="utf-8")
    assert [r[0] for r in read_delimited(spark, str(tmp_path / "x.tsv"), empty_is_null=True).collect()] == ["quoted text", "a", "plain"]
