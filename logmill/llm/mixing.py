"""Mixing to target weights with soft domain membership.

A table of labelled documents says which domain some documents belong to. From it a
classifier is counted: how often each domain has a text whose features fall into each
bin (naive Bayes; features are shares of kinds of characters in the whole text). It
gives every document, labelled or not, a posterior over the domains.

Rates are then fitted by projected gradient: rate times tokens times posterior, summed
over documents, is the expected number of tokens of a domain, and these totals are to
match the targets in least squares, each domain's error relative to its present total,
with a small pull of each rate towards 1 and no rate below ``lower``. A step needs only
one total per domain, summed by Spark; documents with the same bins have the same
posterior and the same rate, so the steps run over one row for each combination of
bins. A rate is the fold of its steps over the history of the totals, so nothing is
kept per document, and it is worked out again, within the row, where it is used.

Only DataFrame functions run. What reaches the driver, or a plan as literals, is of
the size of domains x features x bins.

Edge cases: null and empty texts have no tokens and the posterior of bins 0; domains
that are null or have no labelled row in ``docs`` don't exist, and targets for them are
ignored; without any labelled row all rates are 1; repeated rows count as often as they
come; rows with null id are mixed by the hash of their text. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.session import materialize

#: Characters whose share of a text is a feature.
FEATURES = {
    "umlauts": "[äöüßÄÖÜ]",
    "accents": "[éèêçÉÈÊÇ]",
    "tildes": "[ñóíáúÑÓÍÁÚ]",
    "capitals": "[A-Z]",
    "marks": "[!|%$&#*]",
    "blanks": " ",
}
BINS = 20
WORDS = r"[^\x20\x09-\x0D]+"


def bins_of(text: Column) -> Column:
    """One bin for each feature: the share per mille on a log scale."""
    size = F.greatest(F.length(text), F.lit(1))

    def bin_of(pattern: str) -> Column:
        share = F.regexp_count(text, F.lit(pattern)) * 1000 / size
        return F.least(F.floor(F.log2(share + 1) * 2), F.lit(BINS - 1)).cast("int")

    return F.array(*[bin_of(p) for p in FEATURES.values()])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, bins and a number in [0, 1) for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return docs.select(
        "doc_id", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("tokens"), bins_of(text).alias("bins"), draw.alias("draw")
    )


@dataclass
class DomainClassifier:
    """Log prior and log likelihoods, by domain, feature and bin."""

    domains: list[str]
    prior: list[float]
    likelihood: list[list[list[float]]]

    def posterior(self, bins: Column) -> Column:
        """array<double>: the probability of each domain."""
        logits = []
        for prior, features in zip(self.prior, self.likelihood, strict=True):
            parts = [F.array(*[F.lit(x) for x in row])[bins[j]] for j, row in enumerate(features)]
            logits.append(sum(parts, F.lit(prior)))
        scores = F.transform(
            F.array(F.array(*logits)), lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x)))
        )[0]
        return F.transform(
            F.array(scores),
            lambda x: F.transform(x, lambda y: y / F.aggregate(x, F.lit(0.0), lambda a, b: a + b)),
        )[0]


def fit_classifier(features: DataFrame, labelled: DataFrame, smoothing: float = 0.5) -> DomainClassifier:
    """Counted over all rows of ``features`` that ``labelled(doc_id, domain)`` names."""
    known = labelled.where("domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rows = features.join(known, "doc_id").select("domain", F.posexplode("bins").alias("feature", "bin"))
    counts = rows.groupBy("domain", "feature", "bin").agg(F.count("*").alias("n")).collect()
    domains = sorted({r["domain"] for r in counts})
    table = {(r["domain"], r["feature"], r["bin"]): r["n"] for r in counts}
    sizes = {d: sum(table.get((d, 0, b), 0) for b in range(BINS)) for d in domains}
    every = sum(sizes.values())
    likelihood = [
        [
            [math.log((table.get((d, j, b), 0) + smoothing) / (sizes[d] + smoothing * BINS)) for b in range(BINS)]
            for j in range(len(FEATURES))
        ]
        for d in domains
    ]
    return DomainClassifier(domains, [math.log(sizes[d] / every) for d in domains], likelihood)


@dataclass
class Mixture:
    classifier: DomainClassifier
    lower: float
    pull: float
    present: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    history: list[list[float]] = field(default_factory=list)

    def rate(self, posterior: Column) -> Column:
        """The rate of a document: its steps, one after the other, from 1."""
        start = F.lit(max(1.0, self.lower))
        if not self.history:
            return start
        step = 1.0 / (1.0 + self.pull)
        history = F.array(*[F.array(*[F.lit(x) for x in errors]) for errors in self.history])

        def move(rate: Column, errors: Column) -> Column:
            slope = F.aggregate(F.zip_with(posterior, errors, lambda p, e: p * e), F.lit(0.0), lambda a, b: a + b)
            return F.greatest(F.lit(self.lower), rate - (slope + (rate - 1) * self.pull) * step)

        return F.aggregate(history, start, move)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Weights in proportion to the shares raised to a power below 1."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    return [r / sum(raised) for r in raised] if sum(raised) else raised


def fit_rates(
    features: DataFrame,
    classifier: DomainClassifier,
    targets: dict[str, float] | None = None,
    exponent: float = 0.7,
    prefer: Callable[[str], float] = lambda domain: 1.0,
    lower: float = 0.0,
    pull: float = 1e-3,
    steps: int = 25,
    close: float = 2e-3,
) -> Mixture:
    """Fit to ``targets`` (weights by domain; present shares to the power ``exponent``
    where none are given), each times what ``prefer`` says of the domain. The budget is all present tokens, or with ``lower`` above 0
    as many as it takes for no domain to need a rate below it."""
    mixture = Mixture(classifier, lower, pull)
    names = classifier.domains
    if not names:
        return mixture
    cells = features.groupBy("bins").agg(F.sum("tokens").alias("tokens"))
    cells = materialize(cells.select("tokens", classifier.posterior(F.col("bins")).alias("posterior")), "mix-cells")

    def totals() -> list[float]:
        rate = mixture.rate(F.col("posterior"))
        rows = cells.select((F.col("tokens") * rate).alias("mass"), "posterior")
        sums = rows.agg(*[F.sum(F.col("mass") * F.col("posterior")[d]).alias(f"d{d}") for d in range(len(names))]).first()
        return [float(x or 0.0) for x in sums]

    first = cells.agg(*[F.sum(F.col("tokens") * F.col("posterior")[d]).alias(f"d{d}") for d in range(len(names))]).first()
    mixture.present = [float(x or 0.0) for x in first]
    every = sum(mixture.present)
    if not every:
        return mixture
    shares = [x / every for x in mixture.present]
    weights = [max(0.0, targets.get(n, 0.0)) for n in names] if targets else tempered(shares, exponent)
    weights = [w * prefer(n) for w, n in zip(weights, names, strict=True)]
    whole = sum(weights) or 1.0
    weights = [w / whole for w in weights]
    budget = 1.0
    if lower > 0:
        budget = max([1.0, *(lower * s / w for s, w in zip(shares, weights, strict=True) if w > 0 and s > 0)])
    mixture.targets = [w * budget * every for w in weights]
    for _ in range(steps):
        mixture.reached = totals()
        errors = [
            (got - want) / have if have > 0 else 0.0
            for got, want, have in zip(mixture.reached, mixture.targets, mixture.present, strict=True)
        ]
        if max(map(abs, errors)) < close:
            break
        mixture.history.append(errors)
    else:
        mixture.reached = totals()
    return mixture


def mixed(features: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, tokens, posterior, rate and copies: the rate rounded up or down at
    random by a hash of the id, so that copies match rates in expectation."""
    if mixture.classifier.domains:
        rows = features.withColumn("posterior", mixture.classifier.posterior(F.col("bins")))
    else:
        rows = features.withColumn("posterior", F.array().cast("array<double>"))
    rows = rows.withColumn("rate", mixture.rate(F.col("posterior")))
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.select("doc_id", "tokens", "posterior", "rate", copies.cast("long").alias("copies"))


def mix_rows(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``docs``, columns unchanged, each row as often as its copies say."""
    wide = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    rows = wide.select("__row", bins_of(text).alias("__bins"), draw.alias("__draw"))
    if mixture.classifier.domains:
        rows = rows.withColumn("__posterior", mixture.classifier.posterior(F.col("__bins")))
        rows = rows.withColumn("__rate", mixture.rate(F.col("__posterior")))
    else:
        rows = rows.withColumn("__rate", F.lit(1.0))
    copies = F.floor("__rate") + F.when(F.col("__draw") < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return rows.select("__row", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("__copy")).select("__row.*")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents: language and quality, as 'fr-1'."""
    named = docs.where("lang IS NOT NULL").select("doc_id", "lang")
    marked = labels.where("quality IS NOT NULL").select("doc_id", "quality")
    return named.join(marked, "doc_id").select("doc_id", F.concat_ws("-", "lang", "quality").alias("domain"))
