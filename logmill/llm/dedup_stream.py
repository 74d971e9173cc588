"""Exact duplicates by a stream with keyed state.

Texts are equal when they are identical after lower-casing A-Z. A stream reads the
files; its state is keyed by the digest of the normalised text, kept on disk
(RocksDB) and never expires. For each digest it retains a count, the largest
``doc_id`` and the locator of that row's content: its file and its place in it.
Each micro-batch appends the digests it changed to a log in the shared folder; a
stream that is started again on the same folder goes on where it stopped.

Digests that came more than once are hits: the bytes of every hit are compared
with the bytes at the locator. Rows that share a digest but not the bytes are
grouped anew by their bytes, so a collision costs time, not a wrong result.

Edge cases: null text counts as empty; a null ``doc_id`` is less than any other;
of rows with equal text and equal id the one later in file order stays, one row
alone; an empty folder gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.common import lower_ascii
from logmill.session import materialize, scratch_path

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # many small stores: take disk as it is needed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
PLACE = "struct(doc_id, file, row) as place"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(files: DataFrame) -> DataFrame:
    """doc_id, normalised text, and where the row is."""
    return files.select(
        "doc_id",
        lower_ascii(F.col("text")).alias("norm"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def stream_digests(
    spark: SparkSession, path: str, folder: str, digest=sha256_hex, files_per_batch: int | None = None
) -> None:
    """Run the stream over the Parquet files at ``path`` that it has not seen yet,
    and log each batch's changed digests under ``folder``."""
    session = spark.newSession()
    for key, value in STATE_STORE.items():
        session.conf.set(key, value)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):  # a new session has the defaults
        session.conf.set(key, spark.conf.get(key))
    reader = session.readStream.schema(spark.read.parquet(path).select("doc_id", "text").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern, the path may be one file or a folder of files
    rows = _located(reader.parquet(f"{path[:-1]}[{path[-1]}]")).select(digest(F.col("norm")).alias("digest"), F.expr(PLACE))
    state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("place").alias("place"))

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    run = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(log)
        .start()
    )
    run.awaitTermination()


def retained(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, place): the state after the last batch, read from the log."""
    log = spark.read.parquet(f"{folder}/log")
    return log.groupBy("digest").agg(F.max("n").alias("n"), F.max("place").alias("place"))


def _at(place: str) -> Column:
    return (F.col("file") == F.col(f"{place}.file")) & (F.col("row") == F.col(f"{place}.row"))


def _answer(rows: DataFrame) -> DataFrame:
    """The result's columns, from rows with their group's ``n`` and ``place``."""
    return rows.select(
        "doc_id",
        F.col("place.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        _at("place").alias("kept"),
        "text_sha256",
    )


def exact_duplicates(
    spark: SparkSession, path: str, digest=sha256_hex, files_per_batch: int | None = None, folder: str | None = None
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row at ``path``."""
    path = path.rstrip("/")
    folder = folder or scratch_path(spark, "dedup")
    texts = _located(spark.read.parquet(path))
    sha = sha256_hex(F.col("norm")).alias("text_sha256")
    keyed = texts.select("doc_id", "file", "row", digest(F.col("norm")).alias("digest"), sha, "norm")
    if texts.isEmpty():
        return _answer(keyed.withColumns({"n": F.lit(0), "place": F.expr("struct(doc_id, file, row)")}))
    stream_digests(spark, path, folder, digest, files_per_batch)
    state = materialize(retained(spark, folder), "dedup-state")

    hits = materialize(
        keyed.join(state.where("n > 1"), "digest").select("digest", "doc_id", "file", "row", "place", "text_sha256", "norm"),
        "dedup-hits",
    )
    kept = materialize(hits.where(_at("place")).select("digest", F.col("norm").alias("kept_norm")), "dedup-kept")
    other = materialize(
        hits.join(kept, "digest").where("norm != kept_norm").drop("kept_norm", "place"), "dedup-collisions"
    )
    rows = keyed.drop("norm")
    if other.isEmpty():
        return _answer(rows.join(state, "digest"))

    # one digest, several texts: those that differ from the kept bytes form groups of their own
    own = other.groupBy("norm").agg(F.count("*").alias("n"), F.max(F.expr("struct(doc_id, file, row)")).alias("place"))
    gone = other.groupBy("digest").agg(F.count("*").alias("gone"))
    agreed = state.join(gone, "digest", "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
    first = rows.join(other.select("file", "row"), ["file", "row"], "left_anti").join(agreed, "digest")
    return _answer(first).unionByName(_answer(other.join(own, "norm")))
