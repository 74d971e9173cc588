"""A corpus pipeline: each stage works on all rows that the one before it kept.

1. Toxicity: documents that the classifier rejects go.
2. Line dedup: passages of 50 words or more that came before are cut out of the text.
3. SimHash near-dedup: one document of each group stays (three words, at most three bits apart).
4. Mixing: documents are repeated so that the tokens of each domain come closer to its
   target weight; no rate is below 1, so no document is lost.
5. Byte-level BPE: token ids, and the digest of the text decoded from them.

Stages read rows more than once, so each gets a table. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm import bpe, lines, mixing, simhash, toxicity
from logmill.llm.common import column, rank_path, table
from logmill.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.delete_repeated_lines(docs).select(*map(column, docs.columns))
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs, words=3)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    features = materialize(mixing.featured(docs), "mix-features")
    classifier = mixing.fit_classifier(features, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))
    return mixing.mix_rows(docs, mixing.fit_rates(features, classifier, exponent=0.9, lower=1.0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, rank_path(), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_passages),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("mixing", mix_to_targets),
    ("byte bpe", encode),
]

#: Trained models have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
