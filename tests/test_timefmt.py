from lexiframe.functions.timefmt import format_count, format_elapsed, format_percent, split_minutes_seconds


def test_elapsed_goldens(spark):
    cases = [(0.5, "0:00:00"), (1.5, "0:00:02"), (59.6, "0:01:00"), (3661.2, "1:01:01"),
             (86399.0, "23:59:59"), (86400.0, "1 day, 0:00:00"), (2 * 86400 + 5.0, "2 days, 0:00:05")]
    df = spark.createDataFrame([(x,) for x, _ in cases], "s double")
    got = [r[0] for r in df.select(format_elapsed("s")).collect()]
    assert got == [t for _, t in cases]


def test_minutes_seconds_truncate(spark):
    df = spark.createDataFrame([(125.9,), (59.99,)], "s double")
    m, s = split_minutes_seconds("s")
    assert [tuple(r) for r in df.select(m, s).collect()] == [(2, 5), (0, 59)]


def test_counts_and_percent(spark):
    df = spark.createDataFrame([(1234567, 1, 8), (5, 1, 3)], "n long, a long, b long")
    got = [tuple(r) for r in df.select(format_count("n"), format_percent("a", "b")).collect()]
    assert got == [("1,234,567", "12.50%"), ("5", "33.33%")]


def test_decimal_text_rounds_once_like_python(spark):
    import random

    from lexiframe.functions.timefmt import format_decimal
    r = random.Random(1)
    xs = [0.0124999999999, 0.1235, 2.6745, 0.0025, 1.0005, -0.0001, -1.2345, 0.0, 12.3456, 0.0625, 123456789012.5, 1e17]
    xs += [r.randrange(10**6) / 2000 for _ in range(500)] + [r.random() * 10 ** r.randrange(-4, 6) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [t[0] for t in df.select(format_decimal("x", 3)).collect()] == [f"{x:.3f}" for x in xs]
    assert [t[0] for t in df.select(format_percent("x")).collect()] == [f"{x * 100:.2f}%" for x in xs]


def test_percent_of_zero_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "a long, b long")
    assert df.select(format_percent("a", "b")).first()[0] is None
