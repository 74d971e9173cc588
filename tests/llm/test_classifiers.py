import random

import numpy as np
import pytest

from logmill.llm import quality, toxicity
from tests.llm.helpers import ODD, documents

GOOD = "the river runs over old stones and the village sleeps in the evening light".split()
BAD = ["moronface", "scumbagger", "idiotic"]


def corpus(rng, n=400):
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(GOOD, k=rng.randint(5, 80))
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        poor = i % 5 == 0
        text = " | ".join(words).upper() + "!!" if poor else " ".join(words) + "."
        docs.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(random.Random(3))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, toxicity.training_labels(labels))
    truth = {r["doc_id"]: r["toxic"] for r in labels.subtract(toxicity.training_labels(labels)).collect()}
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(truth) > 80
    assert np.mean([found[i] == y for i, y in truth.items()]) > 0.95
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in found.items() if not p}


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = quality.fit_quality(docs, quality.training_labels(labels))
    truth = {r["doc_id"]: r["quality"] for r in labels.subtract(quality.training_labels(labels)).collect()}
    found = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, model).collect()}
    assert np.mean([found[i] == y for i, y in truth.items()]) > 0.95


def test_whole_text_counts(tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    clean = " ".join(GOOD * 40_000)
    assert model.score(clean) < 0.5 < model.score(f"{clean} moronface scumbagger")


def test_gram_sets_do_not_depend_on_segments(monkeypatch):
    whole = toxicity._gram_set("some text with ümlauts " * 50)
    monkeypatch.setattr(toxicity, "SEGMENT", 37)
    assert np.array_equal(whole, toxicity._gram_set("some text with ümlauts " * 50))


def test_convolution_by_hand():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(
        rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)), rng.normal(size=quality.FILTERS),
        rng.normal(size=2 * quality.FILTERS), 0.1,
    )
    text = "abc déf " * 200
    data = quality.text_bytes(text)
    sums = np.array(
        [model.bias + sum(model.taps[j, data[i + j]] for j in range(quality.WIDTH)) for i in range(len(data) - quality.WIDTH + 1)]
    )
    starts = range(0, max(1, -(-len(sums) // quality.STRIDE) - 1))
    chunks = np.array([np.maximum(sums[s * quality.STRIDE : (s + 2) * quality.STRIDE], 0).max(axis=0) for s in starts])
    z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ model.out + model.intercept
    assert quality.probability(text, model) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    taps, bias = rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)), rng.normal(size=quality.FILTERS)
    out = rng.normal(size=2 * quality.FILTERS) * 0.05  # away from certainty
    data = quality.text_bytes("gradient check " * 60)
    grads = [np.zeros_like(taps), np.zeros_like(bias), np.zeros_like(out), np.zeros(1)]
    quality._gradient(data, 1.0, 1.0, taps, bias, out, 0.0, grads)

    def loss(changed):
        model = quality.QualityModel(taps, changed, out, 0.0)
        return -np.log(quality.probability("gradient check " * 60, model))

    for k in range(3):
        step = np.zeros_like(bias)
        step[k] = 1e-2
        assert grads[1][k] == pytest.approx((loss(bias + step) - loss(bias - step)) / 2e-2, rel=0.05, abs=2e-3)


@pytest.mark.parametrize("module, fit, score", [
    (toxicity, "fit_toxicity", "score_toxicity"), (quality, "fit_quality", "score_quality"),
])
def test_odd_rows_and_missing_labels(spark, module, fit, score):
    flag = "toxic" if module is toxicity else "quality"
    docs = documents(spark, ODD).selectExpr("*", "1 AS label", "0 AS score")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (99, None), (4, 0), (7, 1)], f"doc_id long, {flag} int")
    for known in (labels, labels.limit(0)):
        rows = getattr(module, score)(docs, getattr(module, fit)(docs, known)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = documents(spark, [])
    assert getattr(module, score)(empty, getattr(module, fit)(empty, labels)).count() == 0
