"""Toxicity: a linear classifier over character n-grams that are scaled by naive
Bayes log-count ratios.

A text becomes the set of its n-grams of 4, 6 and 8 bytes, lower-cased,
each hashed to one of ``BUCKETS``. The ratio of a bucket is the log of its share of
toxic texts over its share of other texts. Features are the ratios of buckets that
lean to toxic texts (signs of clean text are as good as endless and would let long
texts outvote an insult); a logistic regression weighs them. What is sent to the tasks
is one weight per bucket: 8 MB, whatever the input.

Fitting uses at most ``fit_rows`` labelled texts. Their n-grams are counted in
tasks; the driver gets one row per bucket and the buckets of those texts that
tell the classes apart.

Edge cases: null and empty texts get the score of the intercept and what the
spaces around them say; a table without labelled rows of both classes gives the
share of label 1 (0.5 without any row); repeated rows are scored one by one; null
ids are not held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import labelled_rows, remainder_is, texts_of
from logmill.llm.packs import tidy

ORDERS = (4, 6, 8)
BUCKET_BITS = 21
BUCKETS = 1 << BUCKET_BITS
FIT_ROWS = 12_000
THRESHOLD = 0.7
SEGMENT = 1 << 20


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, a segment of the text at a time."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    longest = max(ORDERS)
    for start in range(0, len(data), SEGMENT):
        part = data[start : start + SEGMENT + longest - 1]
        owned = min(SEGMENT, len(data) - start)
        mixed = part.astype(np.uint32)
        out = []
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            mixed = mixed[:-1] * np.uint32(0x01000193)
            mixed += part[n - 1 :]
            if n in ORDERS:
                spread = (mixed[:owned] ^ np.uint32(n)) * np.uint32(2654435761)
                out.append(spread >> np.uint32(32 - BUCKET_BITS))
        if out:
            yield np.concatenate(out)


def _gram_set(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, of those that are ``wanted``."""
    parts = []
    for found in gram_buckets(text):
        if wanted is not None:
            found = found[wanted[found]]
        parts.append(np.unique(found))
    if not parts:
        return np.zeros(0, np.uint32)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        known = self.weights != 0
        return self._score(text, known)

    def _score(self, text: str, known: np.ndarray) -> float:
        z = self.intercept + float(self.weights[_gram_set(text, known)].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _ratios(counts: DataFrame, least: int) -> np.ndarray:
    """Log-count ratios by bucket, zero for those in fewer than ``least`` texts."""
    got = counts.toArrow()
    bucket, ones, all_ = (got.column(c).to_numpy() for c in ("bucket", "ones", "n"))
    whole = bucket < 0  # one row of totals
    n1, n = float(ones[whole].sum()), float(all_[whole].sum())
    ratios = np.zeros(BUCKETS, np.float32)
    if n1 == 0 or n1 == n:
        return ratios
    share = n1 / n
    keep = ~whole & (all_ >= least)
    b, c1, c = bucket[keep], ones[keep].astype(float), all_[keep].astype(float)
    ratios[b] = np.log((c1 + share) / n1) - np.log((c - c1 + 1 - share) / (n - n1))
    return ratios


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ones, every = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    rows = [0, 0]
    for batch in batches:
        texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
        for text, label in zip(texts, labels, strict=True):
            grams = _gram_set(text)
            every[grams] += 1
            if label:
                ones[grams] += 1
            rows[0] += bool(label)
            rows[1] += 1
    at = np.nonzero(every)[0]
    if rows[1]:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-1], at]).astype(np.int32)),
                pa.array(np.concatenate([[rows[0]], ones[at]])),
                pa.array(np.concatenate([[rows[1]], every[at]])),
            ],
            ["bucket", "ones", "n"],
        )


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = FIT_ROWS,
    least_texts: int = 5,
    least_ratio: float = 1.5,
    penalty: float = 1e-5,
    steps: int = 100,
) -> ToxicityModel:
    """Fit on at most ``fit_rows`` rows of ``labels(doc_id, toxic)``."""
    spark = docs.sparkSession
    sample = texts_of(docs, labelled_rows(labels, "toxic", fit_rows))
    counts = (
        sample.mapInArrow(tidy(_count_grams), "bucket int, ones long, n long")
        .groupBy("bucket")
        .agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    )
    ratios = _ratios(counts, least_texts)
    telling = spark.sparkContext.broadcast(ratios >= least_ratio)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [_gram_set(t, telling.value).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(grams, pa.list_(pa.int32()))], ["label", "grams"]
            )

    got = sample.mapInArrow(tidy(features), "label int, grams array<int>").toArrow()
    labels_ = got.column("label").to_numpy().astype(np.float64)
    if len(labels_) == 0 or labels_.min() == labels_.max():
        share = min(max(labels_.mean() if len(labels_) else 0.5, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    grams = got.column("grams").combine_chunks()
    sizes = np.diff(grams.offsets.to_numpy())
    return _regress(grams.flatten().to_numpy(), sizes, labels_, ratios, penalty, steps)


def _regress(
    grams: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ratios: np.ndarray, penalty: float, steps: int
) -> ToxicityModel:
    """Logistic regression on the scaled features by Adam over all rows."""
    used, column = np.unique(grams, return_inverse=True)
    scale = ratios[used].astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = scale[column]
    w, b = np.zeros(len(used)), float(np.log(labels.mean() / (1 - labels.mean())))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, value * w[column], len(sizes))
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.append(
            np.bincount(column, value * error[row], len(used)) / len(sizes) + penalty * w, error.mean()
        )
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * scale
    return ToxicityModel(weights, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.weights != 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = pa.array([shared.value._score(t, known) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(score, f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learned from: those not held out."""
    return labels.where(~remainder_is("doc_id", 3, 1))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.weights != 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            clean = [shared.value._score(t or "", known) < threshold for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
