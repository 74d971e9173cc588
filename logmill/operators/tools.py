"""Analytical reports on lines, tables, times and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmill.functions import dims
from logmill.functions.expr import first_match, strip
from logmill.session import materialize


def _line_counts(lines: DataFrame) -> DataFrame:
    # Copies of a line collapse in each task before the shuffle.
    return (
        lines.where(strip(F.col("line")) != "")
        .groupBy("file_id", "line")
        .agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    )


def line_duplicates(lines: DataFrame) -> DataFrame:
    """A1: total, unique and redundant non-blank lines of each file."""
    return (
        _line_counts(lines)
        .groupBy("file_id")
        .agg(
            F.sum("n").alias("total_lines"),
            F.count("*").alias("unique_lines"),
            F.sum(F.col("n") - 1).alias("redundant_lines"),
        )
    )


def top_recurring_lines(lines: DataFrame, k: int = 5) -> DataFrame:
    """A2: the most common repeated lines of each file, whole and cut at 75 for display."""
    order = Window.partitionBy("file_id").orderBy(F.col("n").desc(), "first_line")
    return (
        _line_counts(lines)
        .where(F.col("n") > 1)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            "file_id",
            "rank",
            "n",
            F.when(
                F.length("line") > 75, F.concat(F.substring("line", 1, 75), F.lit("..."))
            ).otherwise(F.col("line")).alias("display"),
            "line",
        )
    )


def row_duplicates(table: DataFrame) -> DataFrame:
    """A3: total, unique and duplicate rows of a table."""
    return (
        table.groupBy(*table.columns)
        .agg(F.count("*").alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
            F.count("*").alias("unique_rows"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def top_row_values(table: DataFrame, k: int = 5) -> DataFrame:
    """A4: the most common full rows; rows with nulls are left out."""
    return (
        table.dropna()
        .groupBy(*table.columns)
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), *table.columns)
        .limit(k)
    )


def _first_time(line: Column) -> Column:
    """The leftmost timestamp of a line in any of four shapes, blanks squeezed."""
    found = first_match(line, "|".join(f"(?:{rx})" for rx, _ in dims.TIME_SHAPES.values()))
    return F.regexp_replace(found, r"\s+", " ")


def _parsed_time(found: Column, year: int) -> Column:
    """The timestamp of a match; a shape without a year gets ``year``."""
    patterns = {shape: F.lit(pattern) for shape, (_, pattern) in dims.TIME_SHAPES.items()}
    # The shapes differ in one character each: T, a letter, a slash, a dash.
    return (
        F.when(
            F.substring(found, 1, 1) > "9",
            F.try_to_timestamp(F.concat(F.lit(f"{year} "), found), patterns["syslog"]),
        )
        .when(F.substring(found, 3, 1) == "/", F.try_to_timestamp(found, patterns["common"]))
        .when(F.substring(found, 11, 1) == "T", F.try_to_timestamp(found, patterns["iso_t"]))
        .otherwise(F.try_to_timestamp(found, patterns["iso"]))
    )


def timed_lines(lines: DataFrame, year: int) -> DataFrame:
    """(file_id, line_no, ts); ``ts`` is null where a line has no time."""
    # Nulls are left to the aggregates: a filter on ts would be pushed below
    # and run every regex twice.
    return lines.select("file_id", "line_no", _first_time(F.col("line")).alias("_found")).select(
        "file_id", "line_no", _parsed_time(F.col("_found"), year).alias("ts")
    )


def timeline_text(lines: DataFrame, year: int) -> DataFrame:
    """A5: start, end, duration in seconds and events of each file."""
    return (
        timed_lines(lines, year)
        .groupBy("file_id")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("ts").alias("events"))
        .where(F.col("events") > 0)
        .withColumn(
            "duration_seconds", F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")
        )
    )


def time_column(columns: list[str]) -> str | None:
    """The first column whose name speaks of a date or a time."""
    return next((c for c in columns if "date" in c.lower() or "time" in c.lower()), None)


def timeline_table(table: DataFrame) -> DataFrame:
    """Range of the first date or time column, and the number of rows."""
    column = time_column(table.columns)
    if column is None:
        raise ValueError("the table has no date or time column")
    ts = F.col(f"`{column}`")
    if dict(table.dtypes)[column] == "string":
        ts = F.try_to_timestamp(ts)
    return table.agg(
        F.lit(column).alias("time_column"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count("*").alias("entries"),
    )


def hourly_histogram(lines: DataFrame, year: int) -> DataFrame:
    """Events per file and hour of the day."""
    return (
        timed_lines(lines, year)
        .groupBy("file_id", F.hour("ts").alias("hour"))
        .agg(F.count("ts").alias("events"))
        .where(F.col("events") > 0)
    )


def peak_hour(lines: DataFrame, year: int) -> DataFrame:
    """The hour with most events; on equal counts the lower hour."""
    best = F.max(F.struct(F.col("events"), (-F.col("hour")).alias("neg"), F.col("hour")))
    return (
        hourly_histogram(lines, year)
        .groupBy("file_id")
        .agg(best.alias("b"))
        .select("file_id", F.col("b.hour").alias("peak_hour"), F.col("b.events").alias("events"))
    )


def _pattern_matches(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    def matches(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.flatten(F.array(*[matches(kind, rx) for kind, rx in patterns.items()]))
    return (
        lines.select("file_id", "line_no", F.posexplode_outer(found).alias("pos", "m"))
        .where(F.col("m").isNotNull())
        .select("file_id", "line_no", "pos", "m.kind", "m.value")
    )


def _pattern_report(lines: DataFrame, patterns: dict[str, str], k: int) -> DataFrame:
    # The lines are searched once; the distinct values, far fewer, are read twice.
    values = materialize(
        _pattern_matches(lines, patterns)
        .groupBy("file_id", "kind", "value")
        .agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first")),
        "values",
    )
    totals = values.groupBy("file_id", "kind").agg(
        F.sum("n").alias("matches"), F.count("*").alias("distinct_values")
    )
    order = Window.partitionBy("file_id", "kind").orderBy(F.col("n").desc(), "first")
    top = values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(totals, ["file_id", "kind"]).select(
        "file_id", "kind", "rank", "value", "n", "matches", "distinct_values"
    )


def extract_patterns(lines: DataFrame, kinds: list[str] | None = None, k: int = 5) -> DataFrame:
    """Addresses, e-mails and links: totals and the most common of each file."""
    kinds = kinds or list(dims.EXTRACT_PATTERNS)
    return _pattern_report(lines, {n: dims.EXTRACT_PATTERNS[n] for n in kinds}, k)


def extract_http_errors(lines: DataFrame, k: int = 5) -> DataFrame:
    """A10: the same for 4xx and 5xx codes."""
    return _pattern_report(lines, {"error_code": dims.HTTP_ERROR_CODE}, k)


def table_cells(table: DataFrame, file_id: str) -> DataFrame:
    """Every cell of a table as a line, so that A9 and A10 see whole tables.

    ``line_no`` is the column's position: the table has no row order to keep.
    """
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in table.columns])
    return table.select(
        F.lit(file_id).alias("file_id"), F.posexplode(cells).alias("line_no", "line")
    ).where(F.col("line").isNotNull())
