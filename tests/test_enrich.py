import json

import pytest
from pyspark.sql import functions as F

from logmill.functions import dims
from logmill.operators import enrich, parse

CACHE = "signature string, severity string, summary string, solution string, reference_url string"


def test_dedupe_keeps_the_first_of_equal_heads(lines):
    head = "error " + "a" * 194
    df = lines(head + "1", head + "2", "error " + "a" * 100, "warn x", "warn x")
    found = parse.extract_events(df)
    for chars, lines_left in ((200, [1, 3, 4]), (None, [1, 2, 3, 4])):
        events = enrich.dedupe_incidents(found, chars)
        assert sorted(r["line_no"] for r in events.collect()) == lines_left


def test_signature_is_shorter_than_the_dedupe_key(lines):
    head = "error " + "a" * 94
    rows = enrich.with_signature(
        parse.extract_events(lines(head + "b" * 50, head + "c" * 50, "x--y")), 100
    ).collect()
    by_line = {r["line_no"]: r["signature"] for r in rows}
    assert by_line[1] == by_line[2] == "ERROR:" + head
    assert by_line[3] == "SQL Injection (SQLi)"


@pytest.mark.parametrize("strict, warning", [(False, "Medium"), (True, "High")])
def test_fixed_incident_resolution(lines, strict, warning):
    rows = enrich.fallback_incident_resolution(
        parse.extract_events(lines("error a b", "warn c")), strict_warn=strict
    ).orderBy("line_no").collect()
    assert [r["severity"] for r in rows] == ["High", warning]
    assert rows[0]["solution"] == "Investigate the ERROR log: error a b"
    assert rows[0]["reference_url"] == "https://google.com/search?q=error+a+b"
    assert rows[0]["summary"] == ""


def test_fixed_attack_resolution(spark):
    types = list(dims.FIXED_RESOLUTIONS) + ["Other"]
    df = spark.createDataFrame([(t,) for t in types], "vuln_type string")
    got = {r["vuln_type"]: (r["severity"], r["summary"], r["solution"], r["reference_url"])
           for r in enrich.fallback_vuln_resolution(df).collect()}
    assert got == {**dims.FIXED_RESOLUTIONS, "Other": dims.DEFAULT_RESOLUTION}


def test_resolution_order_cache_answers_fixed(spark, lines):
    events = parse.extract_events(lines("error one", "error two", "error three"))
    cache = spark.createDataFrame([("ERROR:error one", "Low", "s", "from cache", "u")], CACHE)
    answers = spark.createDataFrame(
        [("ERROR:error one", "Low", "s", "from model", "u"), ("ERROR:error two", "Low", "s", "from model", "u")], CACHE
    )
    rows = enrich.resolve_incidents(events, cache, answers).orderBy("line_no").collect()
    assert [r["solution"] for r in rows] == ["from cache", "from model", "Investigate the ERROR log: error three"]


def test_attacks_use_the_cached_type(spark, lines):
    vulns, _ = parse.split_vulns(parse.extract_events(lines("a--b", "<script>")))
    cache = spark.createDataFrame([("SQL Injection (SQLi)", "Low", "s", "known", "u")], CACHE)
    rows = enrich.resolve_vulns(vulns, cache).orderBy("line_no").collect()
    assert [r["severity"] for r in rows] == ["Low", "High"]


def test_cache_upsert_keeps_stored_rows(spark):
    cache = spark.createDataFrame([("a", "Low", "", "old", "")], CACHE)
    new = spark.createDataFrame([("a", "High", "", "new", ""), ("b", "High", "", "x", ""), ("b", "High", "", "x", "")], CACHE)
    rows = sorted((r["signature"], r["solution"]) for r in enrich.cache_upsert(cache, new).collect())
    assert rows == [("a", "old"), ("b", "x")]


@pytest.mark.parametrize(
    "response, expected",
    [
        (json.dumps({"severity": "Low", "summary": "s", "solution": "do", "reference_url": "u"}), ("Low", "s", "do", "u")),
        ('Sure!\n{"solution": "do"}\nbye', ("Medium", dims.DEFAULT_RESOLUTION[1], "do", None)),
        ('{"solution": ["a", "b"], "summary": "s"}', ("Medium", "s", "a b", None)),
        ('{"solution": "do", "cve_id": "CVE-2021-1"}', ("Medium", dims.DEFAULT_RESOLUTION[1], "[CVE: CVE-2021-1] do", None)),
        ('{"solution": "do", "cve_id": "none"}', ("Medium", dims.DEFAULT_RESOLUTION[1], "do", None)),
        ("{}", ("Medium", dims.DEFAULT_RESOLUTION[1], dims.ANSWER_DEFAULT_SOLUTION, None)),
        ('{"solution": ', dims.FIXED_RESOLUTIONS["Command Injection"]),
        ("no json", dims.FIXED_RESOLUTIONS["Command Injection"]),
    ],
)
def test_model_answers(spark, response, expected):
    df = spark.createDataFrame([("sig", "Command Injection", response)], "signature string, vuln_type string, response string")
    (row,) = enrich.parse_resolution_json(df).collect()
    url = expected[3] or dims.FIXED_RESOLUTIONS["Command Injection"][3]
    assert (row["severity"], row["summary"], row["solution"], row["reference_url"]) == (*expected[:3], url)


def test_requests_are_distinct_and_unknown(spark, lines):
    events = parse.extract_events(lines("error one", "error one", "error two", "a--b"))
    cache = spark.createDataFrame([("ERROR:error two", "Low", "", "", "")], CACHE)
    rows = enrich.resolution_requests(events, cache).collect()
    assert sorted(r["signature"] for r in rows) == ["ERROR:error one", "SQL Injection (SQLi)"]
    assert all(r["message"] in r["prompt"] if "message" in r else "Log Message: " in r["prompt"] for r in rows)


def test_listing_filters_and_orders(spark):
    rows = [("f", 1, 0, "ERROR", "High", "2024-01-01"), ("f", 2, 0, "WARNING", None, "2024-01-03"), ("g", 1, 0, "ERROR", None, "2024-01-02")]
    events = spark.createDataFrame(rows, "file_id string, line_no long, category_no int, entry_type string, severity string, created_on string")
    got = [(r["file_id"], r["line_no"], r["priority"]) for r in enrich.list_events(events, limit=2).collect()]
    assert got == [("f", 2, "Medium"), ("g", 1, "Medium")]
    assert enrich.list_events(events, file_id="f", entry_type="ERROR").count() == 1
    vulns = events.withColumns({"analyzed_on": F.col("created_on"), "vuln_type": F.lit("x")})
    assert enrich.list_vulns(vulns, vuln_type="x", severity="High").count() == 1


def test_failed_calls_and_answers(spark):
    """No response: an incident is for a person, an attack gets its fixed text; an answer beats the fixed text."""
    rows = [("ERROR:x", None, None), ("SQL Injection (SQLi)", "SQL Injection (SQLi)", None), ("ERROR:y", None, "no json")]
    read = enrich.parse_resolution_json(spark.createDataFrame(rows, "signature string, vuln_type string, response string"))
    got = {r["signature"]: (r["severity"], r["summary"], r["solution"], r["reference_url"]) for r in read.collect()}
    assert got["ERROR:x"] == dims.FAILED_CALL_RESOLUTION
    assert got["SQL Injection (SQLi)"] == dims.FIXED_RESOLUTIONS["SQL Injection (SQLi)"]
    assert got["ERROR:y"] == dims.DEFAULT_RESOLUTION
