"""Log lines to findings and events.

Input ``lines(file_id, line_no, line)``. Scanning is a narrow projection: no
shuffle, one regex test per attack category, and the level tests run only on
lines without a finding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmill.functions import dims
from logmill.functions.expr import (
    contains_any,
    head,
    line_level,
    line_timestamp,
    matches_attack,
    parse_line_timestamp,
    strip,
)

_ATTACKS = list(dims.ATTACK_PATTERNS)


def _flagged(lines: DataFrame, text: str) -> DataFrame:
    """Adds ``_low`` and one boolean per attack category (``_a1`` ...).

    Kept as plain columns of a projection, each test runs once per line and
    the stage stays in generated code.
    """
    low = lines.withColumn("_low", F.lower(text))
    return low.withColumns(
        {
            f"_a{no}": matches_attack(F.col(text), F.col("_low"), name)
            for no, name in enumerate(_ATTACKS, start=1)
        }
    )


def _flags() -> list[Column]:
    return [F.col(f"_a{no}") for no in range(1, len(_ATTACKS) + 1)]


def _hit_structs() -> list[Column]:
    """From the flags: (category_no, type) per category, null where it misses."""
    return [
        F.when(F.col(f"_a{no}"), F.struct(F.lit(no).alias("category_no"), F.lit(name).alias("type")))
        for no, name in enumerate(_ATTACKS, start=1)
    ]


def line_times(lines: DataFrame) -> DataFrame:
    """The first ``YYYY-MM-DD HH:MM:SS`` of each line, as text and as time."""
    return lines.select(
        "file_id", "line_no", line_timestamp(F.col("line")).alias("logged_on")
    ).withColumn("logged_ts", parse_line_timestamp(F.col("logged_on")))


def line_levels(lines: DataFrame) -> DataFrame:
    """ERROR, WARNING or null for each line."""
    low = lines.withColumn("_low", F.lower("line"))
    return low.select("file_id", "line_no", line_level(F.col("line"), F.col("_low")).alias("level"))


def scan_signatures(lines: DataFrame, chars: int | None = None) -> DataFrame:
    """Findings, at most one per line and attack category, with the line or its
    first ``chars``."""
    return (
        _flagged(lines.select("file_id", "line_no", "line"), "line")
        .select("file_id", "line_no", "line", F.explode(F.array(*_hit_structs())).alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(
            "file_id",
            "line_no",
            "hit.category_no",
            "hit.type",
            head(strip(F.col("line")), chars).alias("content"),
        )
    )


def extract_events(lines: DataFrame, chars: int | None = None) -> DataFrame:
    """One Vulnerability event per category hit, else one level event.

    Gives ``file_id, line_no, category_no, entry_type, vuln_type, message,
    logged_on, logged_ts``; ``category_no`` is 0 for level events. The message is the
    line or its first ``chars``.
    """
    no_attack = ~reduce(lambda a, b: a | b, _flags())
    level = F.when(no_attack, line_level(F.col("text"), F.col("_low")))
    level_hit = F.when(
        F.col("_level").isNotNull(),
        F.struct(F.lit(0).alias("category_no"), F.col("_level").alias("type")),
    )
    texts = lines.select("file_id", "line_no", strip(F.col("line")).alias("text")).where(
        F.col("text") != ""
    )
    found = (
        _flagged(texts, "text")
        .withColumn("_level", level)
        .select("file_id", "line_no", "text", F.explode(F.array(*_hit_structs(), level_hit)).alias("hit"))
        .where(F.col("hit").isNotNull())
    )
    message = head(F.col("text"), chars)
    is_attack = F.col("hit.category_no") > 0
    return found.select(
        "file_id",
        "line_no",
        F.col("hit.category_no").alias("category_no"),
        F.when(is_attack, F.lit("Vulnerability")).otherwise(F.col("hit.type")).alias("entry_type"),
        F.when(is_attack, F.col("hit.type")).alias("vuln_type"),
        F.when(is_attack, F.concat(F.lit("["), F.col("hit.type"), F.lit("] "), message))
        .otherwise(message)
        .alias("message"),
        line_timestamp(F.col("text")).alias("logged_on"),
    ).withColumn("logged_ts", parse_line_timestamp(F.col("logged_on")))


def split_vulns(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P5: (vulnerabilities, other events). The type is read from the message."""
    vulns = events.where(F.col("entry_type") == "Vulnerability").withColumn(
        "vuln_type", strip(F.replace(F.substring_index("message", "]", 1), F.lit("["), F.lit("")))
    )
    return vulns, events.where(F.col("entry_type") != "Vulnerability")


def keep_error_warning(events: DataFrame) -> DataFrame:
    """P6."""
    return events.where(F.col("entry_type").isin("ERROR", "WARNING"))


def scan_summary(lines: DataFrame) -> DataFrame:
    """One row (files_scanned, files_with_findings, findings).

    Clean files count too, so the findings are counted per file in the same
    pass as the lines; the file totals then add up in a small second step.
    """
    findings = reduce(lambda a, b: a + b, [f.cast("long") for f in _flags()])
    per_file = (
        _flagged(lines.select("file_id", "line"), "line")
        .groupBy("file_id")
        .agg(F.sum(findings).alias("n"))
    )
    return per_file.agg(
        F.count("*").alias("files_scanned"),
        F.sum((F.col("n") > 0).cast("long")).alias("files_with_findings"),
        F.sum("n").alias("findings"),
    )


def flat_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the file's name attached (``files(file_id, name)``)."""
    return findings.join(files.select("file_id", "name"), "file_id").select(
        "file_id", "name", "line_no", "type", "content"
    )


def capped_report(findings: DataFrame, per_file: int = 5, total: int = 20) -> DataFrame:
    """The report's lines: the first ``per_file`` findings of each file, the
    first ``total`` over all files in order, and how many more each file has.

    The per-file rank is cut before its shuffle (window group limit) and the
    overall cut is a distributed top-k; only then are the few rows numbered.
    """
    in_file = Window.partitionBy("file_id").orderBy("line_no", "category_no")
    first = (
        findings.withColumn("rank_in_file", F.row_number().over(in_file))
        .where(F.col("rank_in_file") <= per_file)
        .orderBy("file_id", "rank_in_file")
        .limit(total)
    )
    counts = findings.groupBy("file_id").agg(F.count("*").alias("file_findings"))
    # `first` holds at most `total` rows, so it is the side to broadcast.
    return (
        counts.join(F.broadcast(first), "file_id")
        .withColumn("more", F.greatest(F.col("file_findings") - per_file, F.lit(0)))
        .select("file_id", "rank_in_file", "line_no", "type", "content", "file_findings", "more")
    )


def scan_exclusions(files: DataFrame, api: bool = False) -> DataFrame:
    """P10: files outside document folders and not hidden (``files(file_id, path)``).

    Whole path segments are compared; the service form also skips structured
    tables and other documents.
    """
    skip = dims.DOCUMENT_TYPES + (["structured_data", "other_document"] if api else [])
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(
        ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip])) & ~name.startswith(".")
    )


def excluded_by_substring(path: Column) -> Column:
    """Literal form of the path rule: a document type anywhere in the path."""
    return contains_any(path, dims.DOCUMENT_TYPES)
