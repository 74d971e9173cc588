"""DataFrames to files. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_category(df: DataFrame, path: str, column: str = "category") -> None:
    """K1: one folder per category. Rebalancing evens out the files and lets a
    category of any size be written by many tasks."""
    df.hint("rebalance", column).write.mode("append").partitionBy(column).parquet(path)


def write_cluster_report(report: DataFrame, path: str) -> None:
    """K2: CSV of (file_name, summary, cluster_id, category)."""
    report.select("file_name", "summary", "cluster_id", "category").write.mode("overwrite").csv(
        path, header=True, escape='"'
    )


def write_lines_by_category(lines: DataFrame, path: str) -> None:
    """K3: CSV of clustered lines, one folder per category."""
    lines.select("original_log", "source_file", "cleaned_log", "cluster_id", "category").hint(
        "rebalance", "category"
    ).write.mode("overwrite").partitionBy("category").csv(
        path, header=True, escape='"', quoteAll=True
    )


def event_rows(events: DataFrame) -> DataFrame:
    """K4's layout: severity defaults to Medium, with user and time of writing."""
    return events.select(
        "file_id", "line_no", "category_no", "entry_type", "message",
        F.coalesce("severity", F.lit("Medium")).alias("severity"),
        "resolution", "resolution_summary", "reference_url", "logged_on", "logged_ts",
        F.current_user().alias("created_by"), F.current_timestamp().alias("created_on"),
        F.current_user().alias("updated_by"), F.current_timestamp().alias("updated_on"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """K4."""
    event_rows(events).write.mode("append").parquet(path)


def append_vulns(vulns: DataFrame, path: str) -> None:
    """K5: as K4, without a default severity."""
    vulns.select(
        "file_id", "line_no", "category_no", "vuln_type", "message", "severity", "solution",
        F.col("summary").alias("resolution_summary"), "reference_url", "logged_on", "logged_ts",
        F.current_user().alias("created_by"), F.current_timestamp().alias("analyzed_on"),
    ).write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Copy-on-write for updates, deletes and upserts: write beside the table,
    then swap, so the table is never overwritten while it is read."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    live, fresh, old = jvm_path(path), jvm_path(path + ".new"), jvm_path(path + ".old")
    fs = live.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(live) and not fs.rename(live, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, live):
        raise OSError(f"cannot move the new {path} into place")
    fs.delete(old, True)
