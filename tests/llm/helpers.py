"""Small tables with everything that operators must stand."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, partitions=3):
    """Documents from (doc_id, text), spread over partitions."""
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions, "doc_id") if full else spark.createDataFrame([], DOCS)


def table_of(spark, df, tmp_path, name="documents"):
    """The rows as a Parquet table, so that they are read alike each time."""
    path = f"{tmp_path}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, "plain words stand here"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "plain words stand here"),
    (5, "plain words stand here"),
    (None, "no id at all"),
    (None, None),
    (6, LONG),
    (7, "İstanbul 漢字 😀 \x1c don't WE'LL"),
]
