"""Event extraction over a directory stream. Extensions, kept thin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logmill.functions.expr import head
from logmill.operators.parse import extract_events
from logmill.sources.readers import file_id, number_lines


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files of a folder as (path, block, line), each file once."""
    return spark.readStream.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
    )


def stream_events(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Events of every new file, then stop (available-now trigger).

    Each batch overwrites its own folder, so a batch that is run again after a
    failure leaves the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = number_lines(batch).withColumn("file_id", file_id(F.col("path")))
        extract_events(lines).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(events: DataFrame, delay: str = "1 hour", chars: int | None = None) -> DataFrame:
    """E1 on a stream of events; state is kept for ``delay`` of event time."""
    return (
        events.withColumn("head", head(F.col("message"), chars))
        .withWatermark("logged_ts", delay)
        .dropDuplicatesWithinWatermark(["file_id", "entry_type", "head"])
        .drop("head")
    )


def stream_hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per file and clock hour; later rows than ``delay`` are dropped."""
    return (
        events.withWatermark("logged_ts", delay)
        .groupBy("file_id", F.window("logged_ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("events"))
        .select("file_id", F.col("w.start").alias("hour_start"), "events")
    )


def write_updates(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The rows that each batch changed, in a folder per batch. State that the
    watermark has passed is dropped, and rows that come later than that don't count."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        result.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_rows(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New rows of a stream as Parquet files, each row once."""
    return (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def hourly_totals(spark: SparkSession, out: str) -> DataFrame:
    """X3's result from its updates: counts only grow, so the largest is the last."""
    updates = spark.read.parquet(out)
    return updates.groupBy("file_id", "hour_start").agg(F.max("events").alias("events"))
