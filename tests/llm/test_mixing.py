import numpy as np
import pytest
from pyspark.sql import functions as F

from logmill.llm import mixing
from tests.llm.helpers import ODD, documents


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for i in range(300):
        kind = ("de", "fr", "en")[i % 7 % 3]
        letters = {"de": "über für", "fr": "été déjà", "en": "over the"}[kind]
        rows.append((i, f"{letters} " * (1 + i % 17)))
        if i % 2:
            labels.append((i, kind))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string")


@pytest.fixture(scope="module")
def fitted(tables):
    features = mixing.featured(tables[0]).cache()
    return features, mixing.fit_classifier(features, tables[1])


def test_posterior_against_numpy(tables, fitted):
    features, classifier = fitted
    rows = features.select("bins", classifier.posterior(F.col("bins")).alias("p")).collect()
    for r in rows[:50]:
        logits = np.array(classifier.prior) + [
            sum(row[b] for row, b in zip(domain, r["bins"], strict=True)) for domain in classifier.likelihood
        ]
        expected = np.exp(logits - logits.max())
        assert r["p"] == pytest.approx((expected / expected.sum()).tolist())
    truth = {r["doc_id"]: r["domain"] for r in tables[1].collect()}
    best = features.select("doc_id", classifier.posterior(F.col("bins")).alias("p")).collect()
    right = [classifier.domains[int(np.argmax(r["p"]))] == truth[r["doc_id"]] for r in best if r["doc_id"] in truth]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("lower, targets", [(0.0, {"de": 5, "fr": 1, "en": 1}), (1.0, None), (0.0, {"de": 1})])
def test_rates_against_plain_steps(fitted, lower, targets):
    features, classifier = fitted
    mixture = mixing.fit_rates(features, classifier, targets, lower=lower, steps=12)
    rows = mixing.mixed(features, mixture).collect()
    tokens, p = np.array([r["tokens"] for r in rows], float), np.array([r["posterior"] for r in rows])
    present = tokens @ p
    assert mixture.present == pytest.approx(present.tolist())
    rates = np.ones(len(rows))
    for _ in range(len(mixture.history)):
        errors = ((tokens * rates) @ p - mixture.targets) / present
        rates = np.maximum(lower, rates - (p @ errors + mixture.pull * (rates - 1)) / (1 + mixture.pull))
    assert [r["rate"] for r in rows] == pytest.approx(rates.tolist(), rel=1e-6, abs=1e-9)
    assert all(abs(r["copies"] - r["rate"]) < 1 and r["rate"] >= lower for r in rows)


def test_totals_reach_the_targets(fitted):
    features, classifier = fitted
    mixture = mixing.fit_rates(features, classifier, {"de": 3, "fr": 2, "en": 1}, steps=60)
    assert mixture.reached == pytest.approx(mixture.targets, rel=0.02)


def test_rows_are_repeated(tables, fitted):
    docs, _ = tables
    features, classifier = fitted
    mixture = mixing.fit_rates(features, classifier, lower=1.0)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(features, mixture).collect()}
    out = mixing.mix_rows(docs, mixture)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies
    assert min(copies.values()) >= 1


def test_no_python_in_the_plan(tables, fitted):
    docs, _ = tables
    features, classifier = fitted
    plan = mixing.mix_rows(docs, mixing.fit_rates(features, classifier))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 AS tokens", "'x' AS bins", "2 AS rate", "3 AS copies")
    for rows in (docs, docs.limit(0)):
        features = mixing.featured(rows)
        for labels in ([(1, "a"), (3, "b"), (None, "a"), (7, None)], []):
            classifier = mixing.fit_classifier(features, spark.createDataFrame(labels, "doc_id long, domain string"))
            mixture = mixing.fit_rates(features, classifier, lower=1.0)
            n = rows.count()
            assert mixing.mixed(features, mixture).count() == n
            out = mixing.mix_rows(rows, mixture)
            assert out.columns == rows.columns and out.count() >= n
