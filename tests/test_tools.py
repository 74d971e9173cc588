import datetime as dt

import pytest

from logmill.operators import tools


def test_line_duplicates(lines):
    df = lines("a", "b", "a", "  ", "", "a ", "b")
    (row,) = tools.line_duplicates(df).collect()
    assert tuple(row) == ("f.log", 5, 3, 2)


def test_top_recurring(lines):
    long = "x" * 80
    df = lines("b", "a", "a", "b", long, long, long, "once")
    rows = tools.top_recurring_lines(df).orderBy("rank").collect()
    assert [(r["display"], r["n"]) for r in rows] == [("x" * 75 + "...", 3), ("b", 2), ("a", 2)]


def test_rows_of_tables(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (3, "y")], "i int, s string")
    assert tuple(tools.row_duplicates(df).first()) == (5, 3, 2)
    assert [tuple(r) for r in tools.top_row_values(df).collect()] == [(1, "x", 2), (3, "y", 1)]


def test_four_time_shapes(lines):
    df = lines(
        "[15/Feb/2024:14:32:49 +0000] GET", "Jan  5 14:32:49 host", "at 2024-01-05T13:00:00Z", "x 2024-01-06 12:00:00 2023-01-01 00:00:00",
        "no time", "Foo 31 10:00:00", "2024-13-45 10:00:00",
    )
    got = [r["ts"] for r in tools.timed_lines(df, 2024).orderBy("line_no").collect()]
    assert got == [
        dt.datetime(2024, 2, 15, 14, 32, 49), dt.datetime(2024, 1, 5, 14, 32, 49), dt.datetime(2024, 1, 5, 13),
        dt.datetime(2024, 1, 6, 12), None, None, None,
    ]


def test_timeline_and_peak(lines):
    df = lines("2024-03-20 10:00:01 a", "2024-03-20 10:04:30 b", "2024-03-20 11:00:00", "2024-03-20 11:00:01", "x")
    (row,) = tools.timeline_text(df, 2024).collect()
    assert (row["duration_seconds"], row["events"]) == (3600, 4)
    (row,) = tools.peak_hour(df, 2024).collect()
    assert (row["peak_hour"], row["events"]) == (10, 2)
    assert tools.timeline_text(lines("none"), 2024).count() == 0
    assert tools.peak_hour(lines("none"), 2024).count() == 0


def test_timeline_of_a_table(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "bad")], "`x` string, `Date first seen` string")
    (row,) = tools.timeline_table(df).collect()
    assert (row["time_column"], row["start_ts"], row["entries"]) == ("Date first seen", dt.datetime(2024, 1, 1), 2)
    with pytest.raises(ValueError):
        tools.timeline_table(df.select("x"))


def test_patterns(lines):
    df = lines("10.0.0.1 10.0.0.2 a.b@c.org", "10.0.0.2 http://x.org/a?b=1, see https://y.org", "1.2.3 x@y nothttp://")
    rows = {(r["kind"], r["rank"]): (r["value"], r["n"], r["matches"], r["distinct_values"]) for r in tools.extract_patterns(df).collect()}
    assert rows[("ip", 1)] == ("10.0.0.2", 2, 3, 2)
    assert rows[("ip", 2)] == ("10.0.0.1", 1, 3, 2)
    assert rows[("email", 1)] == ("a.b@c.org", 1, 1, 1)
    assert rows[("url", 1)][0] == "http://x.org/a?b=1,"
    assert {k for k, _ in rows} == {"ip", "email", "url"}
    only = tools.extract_patterns(df, ["ip"], k=1).collect()
    assert [(r["kind"], r["value"]) for r in only] == [("ip", "10.0.0.2")]


def test_http_errors(lines):
    rows = tools.extract_http_errors(lines("404 500 200 404 4041 x404")).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("404", 2), ("500", 1)]


def test_cells_of_a_table(spark):
    df = spark.createDataFrame([("10.0.0.1", 404), (None, 500)], "`Src IP` string, code int")
    rows = tools.extract_http_errors(tools.table_cells(df, "t")).collect()
    assert sorted(r["value"] for r in rows) == ["404", "500"]
