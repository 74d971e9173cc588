"""Helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rank_path() -> str:
    """The public rank file; its folder is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_tokenizer_path() -> str:
    """The public tokenizer of words; its folder is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder_is(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``remainder``. False for a null id."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def labelled_rows(labels: DataFrame, flag: str, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled documents, chosen by a hash of
    the id and so the same in each run. Ids or flags that are null are left out;
    of an id that is labelled twice the larger flag counts."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(flag).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(flag)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text, label) of the chosen labelled documents, which are at most as many
    as ``labelled_rows`` was told, so they are sent to every task."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
