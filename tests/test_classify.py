import pytest
from pyspark.sql import functions as F

from logmill.functions import dims
from logmill.operators import classify

FILES = "file_id string, name string, text string"


@pytest.fixture
def typed(spark):
    def run(name, text, columns=(), **kw):
        files = spark.createDataFrame([("f", name, text)], FILES)
        cols = spark.createDataFrame([("f", c) for c in columns], "file_id string, column_name string")
        (row,) = classify.route_files(classify.final_file_type(files, cols, **kw)).collect()
        return row

    return run


def keyword_class(spark, name, text):
    files = spark.createDataFrame([("f", name, text)], FILES)
    (row,) = classify.keyword_file_class(files).select("_class.*").collect()
    return row["category"], round(row["confidence"], 6)


def test_fast_path(spark):
    rows = [("a.log", "x info y"), ("a.TXT", "Warned"), ("a.csv", "ERROR"), ("b.log", "timestamp traceback"),
            ("c.log", " " * 1000 + "INFO"), ("d.log", "INFORMATION")]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], FILES)
    for chars, far in ((None, True), (1000, False)):
        hit = classify.log_fast_path(F.col("name"), F.col("text"), chars)
        got = [r["h"] for r in df.orderBy("file_id").select(hit.isNotNull().alias("h")).collect()]
        assert got == [True, True, False, False, far, True]


@pytest.mark.parametrize(
    "name, text, expected",
    [
        ("a.pdf", "Curriculum Vitae. Education, Skills", ("cv", 0.3)),
        ("a.pdf", "education and error", ("log", 0.1)),
        ("a.pdf", "resume objective; skills", ("resume", 0.2)),
        ("a.pdf", "invoice bill payment total tax amount due", ("invoice", 0.6)),
        ("a.log", "nothing", ("log", 0.6)),
        ("a.pdf", "nothing", ("other_document", 0.5)),
        ("a.pdf", "x" * 2000 + " error", ("log", 0.1)),
        ("a.pdf", " ".join(dims.CLASS_KEYWORDS["log"]), ("log", 0.9)),
    ],
)
def test_keyword_class(spark, name, text, expected):
    assert keyword_class(spark, name, text) == expected


def test_labels(spark):
    expected = ["log"] * 8 + ["cv", "resume", "invoice", "report", "report", "contract", "contract", "other_document"]
    df = spark.createDataFrame([(x,) for x in dims.CLASSIFIER_LABELS], "label string")
    got = [r["c"] for r in df.select(classify.normalize_label(F.col("label")).alias("c")).collect()]
    assert got == expected


def test_supplied_label_comes_second(spark):
    rows = [("1", "a.log", "INFO x", "invoice", 0.8), ("2", "a.pdf", "error", "invoice", 0.8), ("3", "a.pdf", "error", None, None)]
    df = spark.createDataFrame(rows, FILES + ", label string, score double")
    got = [(r["category"], r["confidence"]) for r in classify.classify_files(df).orderBy("file_id").collect()]
    assert got == [("log", 1.0), ("invoice", 0.8), ("log", 0.1)]


def test_routes(typed):
    assert typed("a.log", "2024 INFO x")["destination"] == "staging"
    assert typed("cv.pdf", "Curriculum Vitae. Education, Skills")["destination"] == "cv"
    row = typed("data.csv", "1 2 3", ["id", "Src IP"])
    assert (row["file_type"], row["destination"], row["goes_to_analysis"]) == ("other_document", "other_document", False)
    row = typed("data.csv", "1 2 error", ["id", "Src IP"])
    assert (row["file_type"], row["goes_to_analysis"]) == ("log", True)
    assert typed("data.csv", "total", ["id", "amount"])["file_type"] == "invoice"
    row = typed("a.docx", "INFO")
    assert (row["file_type"], row["destination"], row["goes_to_analysis"]) == ("unsupported", None, False)
    assert typed("data.csv", "x", classifier=False)["destination"] == "structured_data"
    assert typed("a.pdf", "x", classifier=False)["file_type"] == "log"


def test_unsure_log_is_checked_again(typed):
    assert typed("a.pdf", "packet and bytes")["file_type"] == "other_document"
    assert typed("a.pdf", "packet bytes level=3")["file_type"] == "log"


def test_table_columns(spark):
    assert classify.has_log_columns(["id", "Description"])  # "ip" inside a word counts
    assert not classify.has_log_columns(["id", "amount"])
    df = spark.createDataFrame([("a", "id"), ("a", "Date first seen"), ("b", "amount")], "file_id string, column_name string")
    got = {r["file_id"]: r["is_log_table"] for r in classify.log_like_tables(df).collect()}
    assert got == {"a": True, "b": False}


def test_ingest_status(spark):
    rows = [("a.csv", True), ("b.x.LOG", True), ("c.png", False), ("d.parquet", False), ("log", True)]
    df = spark.createDataFrame(rows, "name string, ok boolean")
    got = [r["s"] for r in df.select(classify.ingest_status(F.col("name"), F.col("ok")).alias("s")).collect()]
    assert got == ["structured", "text", "unsupported", "error", "text"]


def test_sample_text(spark):
    df = spark.createDataFrame([("t", i, f"v{i}") for i in range(20, 0, -1)], "file_id string, i long, v string")
    (row,) = classify.table_sample_text(df, ["i", "v"], "i", n=2).collect()
    assert row["sample"] == "Table Columns: i, v\nData Sample:\n1 v1\n2 v2"
