"""Quality: a convolutional network over bytes, in numpy.

A text is read as UTF-8 bytes in overlapping chunks that cover all of it. Filters
over ``WIDTH`` bytes, learned as one table of weights per offset and byte value,
are rectified and max-pooled in each chunk; a text is the mean and the maximum of
its chunks' values, combined by a logistic unit into one probability.

Fitting uses at most ``fit_rows`` labelled texts, whole, on the driver; the model
(about 30 KB) is sent to the tasks, which score whole texts in pieces of bounded
size.

Edge cases: null and empty texts are one chunk of padding and get the score that
follows from it; without labelled rows of both classes every score is the share of
label 1 (0.5 without any row); repeated rows are scored one by one; null ids are
not held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.common import labelled_rows, remainder_is, texts_of

WIDTH = 4
FILTERS = 16
STRIDE = 256  # a chunk is two strides long
FIT_ROWS = 2_000
THRESHOLD = 0.3
PIECE = 1 << 18


@dataclass
class QualityModel:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): of the mean, of the maximum
    intercept: float

    def pairs(self) -> list[np.ndarray]:
        """Tables for two bytes at once; the bias sits in the first."""
        tables = []
        for j in range(0, WIDTH, 2):
            table = (self.taps[j][:, None, :] + self.taps[j + 1][None, :, :]).reshape(65536, -1)
            tables.append(table.astype(np.float32) + (self.bias.astype(np.float32) if j == 0 else 0))
        return tables


def text_bytes(text: str | None) -> np.ndarray:
    """The bytes of a text, with zeros at the end for at least one window."""
    data = (text or "").encode()
    return np.frombuffer(data + bytes(WIDTH - 1 if data else WIDTH), np.uint8)


def _blocks(data: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """Maximum of each filter in each stride of windows, (strides, FILTERS)."""
    windows = len(data) - WIDTH + 1
    found = []
    for start in range(0, windows, PIECE):
        stop = min(start + PIECE, windows)
        part = data[start : stop + WIDTH - 1].astype(np.uint16)
        two = (part[:-1] << 8) | part[1:]
        n = stop - start
        sums = pairs[0].take(two[:n], axis=0)
        for k, table in enumerate(pairs[1:], 1):
            sums += table.take(two[2 * k : 2 * k + n], axis=0)
        whole = n // STRIDE * STRIDE
        if whole:
            found.append(sums[:whole].reshape(-1, STRIDE, sums.shape[1]).max(axis=1))
        if whole < n:
            found.append(sums[whole:].max(axis=0, keepdims=True))
    return np.maximum(np.concatenate(found), 0)


def _chunks(blocks: np.ndarray) -> np.ndarray:
    """Chunks of two strides, one stride apart."""
    return np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks


def _pooled(text: str | None, pairs: list[np.ndarray]) -> np.ndarray:
    chunks = _chunks(_blocks(text_bytes(text), pairs))
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def probability(text: str | None, model: QualityModel, pairs: list[np.ndarray] | None = None) -> float:
    pooled = _pooled(text, pairs if pairs is not None else model.pairs())
    return float(_sigmoid(pooled.astype(np.float64) @ model.out + model.intercept))


def fit_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = 6, rate: float = 0.01, seed: int = 7
) -> QualityModel:
    """Fit on at most ``fit_rows`` rows of ``labels(doc_id, quality)``."""
    got = texts_of(docs, labelled_rows(labels, "quality", fit_rows)).orderBy(F.xxhash64("text"), "label").toArrow()
    return train(got.column("text").to_pylist(), got.column("label").to_pylist(), epochs, rate, seed)


def train(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.01, seed: int = 7) -> QualityModel:
    """Stochastic gradients with Adam; the two classes weigh alike."""
    rng = np.random.default_rng(seed)
    taps = rng.normal(0, 0.3, (WIDTH, 256, FILTERS))
    out, bias, intercept = rng.normal(0, 0.1, 2 * FILTERS), np.zeros(FILTERS), 0.0
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return QualityModel(taps, bias, np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    data = [text_bytes(t) for t in texts]
    state = [np.zeros_like(x) for x in (taps, bias, out, np.zeros(1)) for _ in range(2)]
    step, batch = 0, 32
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(taps), np.zeros_like(bias), np.zeros_like(out), np.zeros(1)]
            for i in order[at : at + batch]:
                _gradient(data[i], y[i], weight[i], taps, bias, out, intercept, grads)
            step += 1
            moves = []
            for k, g in enumerate(grads):
                g /= batch
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
            taps -= moves[0]
            bias -= moves[1]
            out -= moves[2] + rate * 1e-3 * out
            intercept -= float(moves[3][0])
    prior = float(np.log(y.mean() / (1 - y.mean())))
    return QualityModel(taps, bias, out, intercept + prior)


def _gradient(data, y, weight, taps, bias, out, intercept, grads) -> None:
    """Add one text's gradients. Only the windows that win a chunk matter."""
    windows = len(data) - WIDTH + 1
    sums = np.broadcast_to(bias, (windows, FILTERS)).astype(np.float32)
    for j in range(WIDTH):
        sums += taps[j].astype(np.float32).take(data[j : j + windows], axis=0)
    starts = np.arange(0, windows, STRIDE)
    blocks = np.maximum(np.maximum.reduceat(sums, starts, axis=0), 0)
    winner = np.stack([s + sums[s : s + STRIDE].argmax(axis=0) for s in starts])
    if len(blocks) > 1:
        second = blocks[1:] > blocks[:-1]
        chunks, won = np.maximum(blocks[:-1], blocks[1:]), np.where(second, winner[1:], winner[:-1])
    else:
        chunks, won = blocks, winner
    best = chunks.argmax(axis=0)
    pooled = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
    error = weight * float(_sigmoid(pooled @ out + intercept) - y)
    grads[2] += error * pooled
    grads[3] += error
    back = np.broadcast_to(error * out[:FILTERS] / len(chunks), chunks.shape).copy()
    back[best, np.arange(FILTERS)] += error * out[FILTERS:]
    back[chunks <= 0] = 0
    grads[1] += back.sum(axis=0)
    column = np.broadcast_to(np.arange(FILTERS), won.shape)
    for j in range(WIDTH):
        np.add.at(grads[0][j], (data[won + j], column), back)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value.pairs()
        for batch in batches:
            scores = [probability(t, shared.value, pairs) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text")
        .mapInArrow(score, f"doc_id {kind}, score double")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learned from: those not held out."""
    return labels.where(~remainder_is("doc_id", 5, 0))
