import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from logmill.functions import dims, expr
from logmill.operators import retrieval, textfeat
from logmill.plans import runs


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, start=1)), "doc_id long, text string")


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_stop_words_are_sparks(spark):
    words = StopWordsRemover.loadDefaultStopWords("english")
    assert sorted(w for w in words if w.isalpha() and len(w) > 1) == dims.ENGLISH_STOP_WORDS


@pytest.mark.parametrize(
    "text, cleaned",
    [("Error 404: Not-Found!\t", "error   not found"), ("ÉTÉ 12_x", "été _x"), ("123", ""), ("a1b2", "ab")],
)
def test_clean_line(spark, text, cleaned):
    assert value(spark, text, expr.clean_line) == cleaned


def test_terms_and_pairs(spark):
    rows = textfeat.term_counts(docs(spark, "The disk of the Disk, é1 a failure", "", "one")).collect()
    got = {(r["doc_id"], r["term"]): r["n"] for r in rows}
    assert got == {(1, "disk"): 2, (1, "é1"): 1, (1, "failure"): 1, (1, "disk disk"): 1, (1, "disk é1"): 1,
                   (1, "é1 failure"): 1, (3, "one"): 1}


def test_term_limit_prefers_counts_then_names(spark):
    rows = textfeat.term_counts(docs(spark, "bb aa cc cc"), k=2).collect()
    assert sorted(r["term"] for r in rows) == ["aa", "cc"]


def test_tfidf_by_hand(spark):
    texts = ["disk full disk", "disk ok", "net gone", "the at"]
    rows = docs(spark, *texts).withColumnRenamed("doc_id", "row_id")
    got = {(r["row_id"], r["term"]): r["weight"] for r in textfeat.tfidf(rows).collect()}
    split = [[w for w in t.split() if w not in ("the", "at")] for t in texts]
    df = Counter(w for t in split for w in set(t))
    expected = {}
    for i, t in enumerate(split, start=1):
        w = {x: n * (math.log((1 + len(texts)) / (1 + df[x])) + 1) for x, n in Counter(t).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        expected.update({(i, x): v / norm for x, v in w.items()})
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in expected)


def test_copies_count_as_rows(spark):
    plain = spark.createDataFrame([(1, "x yy"), (2, "x yy"), (3, "zz")], "row_id long, text string").withColumn("text", F.concat("text", F.lit(" ww")))
    packed = plain.groupBy("text").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"))
    a = {(r["row_id"], r["term"]): round(r["weight"], 12) for r in textfeat.tfidf(plain).collect()}
    b = {(r["row_id"], r["term"]): round(r["weight"], 12) for r in textfeat.tfidf(packed).collect()}
    assert b.items() <= a.items()


def test_vocabulary_limit(spark):
    rows = docs(spark, "aa bb bb cc cc").withColumnRenamed("doc_id", "row_id")
    assert sorted(r["term"] for r in textfeat.tfidf(rows, max_terms=2).collect()) == ["bb", "cc"]


def test_candidates_and_fallback(spark):
    rows = textfeat.keyword_candidates(docs(spark, "info disk", "a\nb", "log", "  ", "server server")).collect()
    got = {(r["doc_id"], r["term"]): (r["n"], r["fallback"]) for r in rows}
    assert got == {(1, "disk"): (1, False), (1, "info disk"): (1, False), (2, "a b"): (0, True),
                   (3, "log"): (0, True), (5, "server server"): (1, False)}


def test_keyword_choice_against_plain_loop(spark):
    rng = np.random.default_rng(3)
    cand = rng.normal(size=(40, 8))
    doc = rng.normal(size=8)
    names = [f"t{i:02d}" for i in range(40)]
    candidates = spark.createDataFrame([(1, n, v.tolist()) for n, v in zip(names, cand)], "doc_id long, term string, embedding array<double>")
    one = spark.createDataFrame([(1, doc.tolist()), (2, doc.tolist())], "doc_id long, embedding array<double>")
    got = [r["term"] for r in textfeat.mmr_keywords(candidates, one, top_n=7).orderBy("rank").collect()]

    def cos(a, b):
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    picked = [max(range(40), key=lambda i: cos(cand[i], doc))]
    while len(picked) < 7:
        rest = [i for i in range(40) if i not in picked]
        picked.append(max(rest, key=lambda i: 0.5 * cos(cand[i], doc) - 0.5 * max(cos(cand[i], cand[j]) for j in picked)))
    assert got == [names[i] for i in picked]


def test_sample_and_entries(spark):
    df = textfeat.doc_sample(docs(spark, "abcdefg", "abcd"), chars=2)
    assert [r["sample"] for r in df.orderBy("doc_id").collect()] == ["abfg", "abcd"]
    for text, n in [("", 0), ("a", 1), ("a\nb\n", 2), ("\n", 1), ("a\n\nb", 3)]:
        assert value(spark, text, textfeat.entry_count) == n == len(text.splitlines())


def test_summaries(spark):
    df = docs(spark, "disk full\ndisk slow\n", "of\nthe", "  ")
    keywords = textfeat.keyword_candidates(df).where("not fallback").select(
        "doc_id", F.row_number().over(textfeat.Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")).alias("rank"), "term"
    ).where("rank <= 2")
    got = {r["doc_id"]: r["summary"] for r in textfeat.file_summary(df, keywords).collect()}
    assert got == {1: "Total Entries: 2. Keywords: disk, disk full", 2: "of the"}
    by_vectors = {r["doc_id"]: r["summary"] for r in runs.summaries_by_vectors(df).collect()}
    assert by_vectors[1].startswith("Total Entries: 2. Keywords: disk")


@pytest.mark.parametrize(
    "text, category",
    [
        ("Agenda and CPU", "agreement"), ("cpu disk nda", "system_log"), ("rapid", "app_log"), ("GDPR audit", "governance_log"),
        ("Total Entries: 3. Keywords: log, Firewall, x", "firewall"), ("summary xy 12", "unstructured_log"), ("", "unstructured_log"),
        ("postgres keywords: total, info", "unstructured_log"),
    ],
)
def test_categories(spark, text, category):
    assert value(spark, text, textfeat.category_by_domain) == category


def test_line_tables(spark, lines):
    got = textfeat.line_table(lines(" a ", "\t", "b")).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(1, "a"), (3, "b")]
    rows = spark.createDataFrame([("t", 2, None), ("t", 1, "x"), ("t", 3, "z")], "file_id string, i long, s string")
    got = textfeat.table_line_table(rows, ["i", "s"], "i", n=2).orderBy("line_no").collect()
    assert [r["line"] for r in got] == ["1 | x", "2 | nan"]


def test_hashed_vectors(spark):
    df = retrieval.embed_column(docs(spark, "disk full", "full disk", "x", ""), dim=32)
    rows = [r["embedding"] for r in df.orderBy("doc_id").collect()]
    assert rows[0] == rows[1] and len(rows[0]) == 32
    assert abs(np.linalg.norm(rows[0]) - 1) < 1e-6 and np.linalg.norm(rows[3]) == 0


def test_nothing_is_cut_unless_asked(spark):
    many = " ".join(f"word{i}" for i in range(700))
    rows = textfeat.keyword_candidates(docs(spark, many))
    assert rows.count() == 1399
    assert textfeat.keyword_candidates(docs(spark, many), 500).count() == 500
    assert textfeat.doc_sample(docs(spark, "y" * 250_000)).first()["sample"] == "y" * 250_000
    short = textfeat.file_summary(docs(spark, "z" * 300), spark.createDataFrame([], "doc_id long, rank int, term string"), 200)
    assert len(short.first()["summary"]) == 200


def shuffled(df):
    """Exchanges that the plan of a DataFrame starts with."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("k", [None, 3])
def test_terms_of_single_rows_are_not_shuffled(spark, k):
    texts = ["disk of the disk full disk", None, "", "log", "é é zz", "of the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for found in (textfeat.term_counts(rows, k), textfeat.keyword_candidates(rows, k)):
        assert shuffled(found) == 0
    got = {(r["doc_id"], r["term"], r["n"]) for r in textfeat.term_counts(rows, k).collect()}
    every = {(0, "disk", 3), (0, "disk disk", 1), (0, "disk full", 1), (0, "full", 1), (0, "full disk", 1), (3, "log", 1), (4, "zz", 1)}
    assert got == (every if k is None else every - {(0, "full", 1), (0, "full disk", 1)})


def test_rows_that_share_an_id_are_counted_together(spark):
    rows = spark.createDataFrame(
        [(1, "aa bb"), (1, "bb cc"), (2, "aa aa"), (None, "zz"), (None, "zz yy"), (3, "bb"), (3, None)], "doc_id long, text string"
    ).repartition(3)
    got = {(r["doc_id"], r["term"], r["n"]) for r in textfeat.term_counts(rows, 2).collect()}
    assert got == {(1, "bb", 2), (1, "aa", 1), (2, "aa", 2), (2, "aa aa", 1), (None, "zz", 2), (None, "yy", 1), (3, "bb", 1)}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_keyword_choice_across_batches(spark, batch):
    """Documents that end within, at and after a batch; ids and vectors that have no partner."""
    rng = np.random.default_rng(7)
    terms = [(i, f"t{i}{j}", rng.normal(size=3).tolist()) for i in (1, 2, 4, 5, None) for j in range(1 + 3 * (i or 2) % 8)]
    own = {i: rng.normal(size=3).tolist() for i in (1, 2, 3, 5, None)}
    kind = "embedding array<double>"
    candidates = spark.createDataFrame(terms, f"doc_id long, term string, {kind}").repartition(3)
    vectors = spark.createDataFrame(list(own.items()), f"doc_id long, {kind}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = textfeat.mmr_keywords(candidates, vectors, top_n=4)
    got = {(r["doc_id"], r["rank"]): r["term"] for r in df.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for i in (1, 2, 5, None):
        mine = sorted((t, v) for d, t, v in terms if d == i)
        for rank, p in enumerate(textfeat._pick(np.array(own[i]), np.array([v for _, v in mine]), 4, 0.5), 1):
            expected[i, rank] = mine[p][0]
    assert got == expected
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
