"""Files to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from logmill.operators.metadata import file_uuid
from logmill.session import materialize
from logmill.sources.folders import FolderListing


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_id(path: Column) -> Column:
    """M7: the UUID in a file's name, else the hash of its whole path, so that files
    of one name in two folders stay apart."""
    return F.coalesce(
        file_uuid(base_name(path)), F.concat(F.lit("AUDIT-"), F.substring(F.sha2(path, 256), 1, 16))
    )


def read_log_lines(
    spark: SparkSession, path: str | list[str], pattern: str = "*.{txt,log,TXT,LOG}"
) -> DataFrame:
    """Files as lines (path, file_id, name, line_no, line). ``pattern`` says which
    names are read, by default those of text files.

    Bad bytes are replaced. See ``number_lines`` for the line numbers, ``file_id`` for
    the ids. Spark's readers skip names that begin with ``_`` or ``.``.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
    )
    return number_lines(raw).select(
        "path", file_id(F.col("path")).alias("file_id"), base_name(F.col("path")).alias("name"), "line_no", "line"
    )


def number_lines(raw: DataFrame) -> DataFrame:
    """Line numbers for (path, block, line) without moving any line.

    A file is read in blocks by many tasks. One pass counts the lines of each
    block; prefix sums over that small table give every block its offset; the
    second pass adds the position within the block. Both passes scan the same
    DataFrame, hence the same file listing and the same splits.
    """
    seq = raw.withColumn("_seq", F.monotonically_increasing_id())
    blocks = seq.groupBy("path", "block").agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_count")
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        blocks.select(
            "path", "block", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before")
        ),
        "blocks",
    )
    joined = seq.join(offsets, ["path", "block"])
    return joined.select(
        "path", (F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias("line_no"), "line"
    )


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole small files, one row each: (path, file_id, name, text)."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text")
        )
        .select("path", file_id(F.col("path")).alias("file_id"), base_name(F.col("path")).alias("name"), "text")
    )


def lines_of_texts(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Lines (keys, line_no, line) of texts; a final line end starts no line."""
    body = F.regexp_replace(text, r"\n\z", "")
    return texts.where(F.length(text) > 0).select(
        *keys, F.posexplode(F.split(body, "\n")).alias("_pos", "line")
    ).select(*keys, (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def read_csv_table(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, multiline: bool = False
) -> DataFrame:
    """CSV with a header and doubled quotes. Give a schema to spare the pass that
    infers one. With ``multiline``, cells may hold line ends; a file is then one task."""
    reader = spark.read.option("header", "true").option("escape", '"').option("multiLine", str(multiline).lower())
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    return reader.csv(path)


def read_parquet_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S3."""
    return spark.read.parquet(path)


def list_landing_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Every file of a folder (path, name, size_bytes, modified): empty ones and those
    whose names begin with ``_`` or ``.`` too. Nothing is opened; see ``folders``."""
    spark.dataSource.register(FolderListing)
    reader = spark.read.format("folder_listing").option("recursive", str(recursive).lower())
    return reduce(DataFrame.unionByName, [reader.load(p) for p in ([path] if isinstance(path, str) else path)])


def walk_scan_targets(spark: SparkSession, path: str | list[str], api: bool = False) -> DataFrame:
    """All files below a folder but hidden ones and those in document folders."""
    from logmill.operators.parse import scan_exclusions

    return scan_exclusions(list_landing_files(spark, path, recursive=True), api)


def load_master_csv(spark: SparkSession, path: str, master: DataFrame) -> DataFrame:
    """The audit table plus the rows of an old CSV report whose id it lacks."""
    from logmill.operators.metadata import insert_if_absent

    old = read_csv_table(spark, path, master.schema, multiline=True).select(*master.columns)
    return insert_if_absent(master, old, "file_id")
