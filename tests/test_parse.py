"""Scanner and parser on small logs; expectations are worked out by hand."""

from pyspark.sql import functions as F

from logmill.functions import dims
from logmill.operators import parse
from logmill.plans import runs

SQLI, XSS, PATH, BRUTE, CMD = list(dims.ATTACK_PATTERNS)


def found(df, *cols):
    return [tuple(r) for r in df.orderBy("file_id", "line_no", "category_no").select(*cols).collect()]


def test_one_finding_per_line_and_category(lines):
    df = lines(
        "INFO: service started",
        "sshd: Failed password for root; invalid user too",
        "q=1 UNION  select name FROM t WHERE 1 OR 1=1",
        "nothing to see",
        "<SCRIPT>alert(1)</script>",
    )
    assert found(parse.scan_signatures(df), "line_no", "type") == [(2, BRUTE), (3, SQLI), (5, XSS)]


def test_every_pattern_hits_and_case_does_not_matter(lines):
    samples = {
        SQLI: ["union\tselect", "or  1=1", "Drop Table", "a--b", "OR '1'='1'", "select * from", "waitfordelay", "PG_SLEEP"],
        XSS: ["<script>", "JavaScript:", "ONERROR=", "onload=", "alert(", "document.cookie", '"><img src=x'],
        PATH: ["../", "..\\", "/etc/passwd", "C:\\Windows\\System32", "boot.ini", "WIN.INI"],
        BRUTE: ["failed PASSWORD", "authentication failure", "Invalid user", "too many authentication failures", "brute check"],
        CMD: ["; cat x", "| nc x", "|bash", "&& wget", "&&curl"],
    }
    assert {k: len(v) for k, v in samples.items()} == {k: len(v) for k, v in dims.ATTACK_PATTERNS.items()}
    for category, texts in samples.items():
        hit = parse.scan_signatures(lines(*texts)).where(F.col("type") == category)
        assert hit.count() == len(texts), category


def test_near_misses(lines):
    df = lines("unionselect", "or 1 =1", "selected * fromage", "scat x", "documentXcookie", "winXini", ";cat")
    assert parse.scan_signatures(df).count() == 0


def test_finding_text_is_stripped_and_cut(lines):
    text = "  \t-- " + "x" * 300
    for chars in (None, 200):
        (row,) = parse.scan_signatures(lines(text), chars).collect()
        assert row["content"] == text.strip()[:chars]


def test_levels_are_whole_words(lines):
    df = lines("an Error here", "NullPointerException", "[crit] x", "warned", "WARN: y", "warning", "fail", "éfail", "fail_over", "fatal warn")
    got = [r["level"] for r in parse.line_levels(df).orderBy("line_no").collect()]
    assert got == ["ERROR", None, None, None, "WARNING", "WARNING", "ERROR", None, None, "ERROR"]


def test_events_of_a_mixed_log(lines):
    df = lines(
        "2024-01-01 10:00:00 INFO started",
        "2024-01-01  10:00:01 ERROR db down",
        "2024-01-01 10:00:02 warning: low disk",
        "",
        "2024-01-01 10:00:03 ERROR Failed password for bob -- x",
        "Exception in thread main",
    )
    got = found(parse.extract_events(df), "line_no", "entry_type", "vuln_type", "logged_on")
    assert got == [
        (2, "ERROR", None, "2024-01-01  10:00:01"),
        (3, "WARNING", None, "2024-01-01 10:00:02"),
        (5, "Vulnerability", SQLI, "2024-01-01 10:00:03"),
        (5, "Vulnerability", BRUTE, "2024-01-01 10:00:03"),
        (6, "ERROR", None, None),
    ]


def test_event_messages_are_cut_after_the_type(lines):
    long = "-- " + "y" * 2000
    for chars in (None, 1000):
        (row,) = parse.extract_events(lines(long), chars).collect()
        assert row["message"] == f"[{SQLI}] {long[:chars]}"
    (row,) = parse.extract_events(lines("error " + "z" * 2000), 1000).collect()
    assert len(row["message"]) == 1000


def test_split_takes_the_type_from_the_message(lines):
    vulns, others = parse.split_vulns(parse.extract_events(lines("a--b", "error", "<script>")))
    assert found(vulns, "line_no", "vuln_type") == [(1, SQLI), (3, XSS)]
    assert found(others, "line_no", "entry_type") == [(2, "ERROR")]


def test_summary_counts_clean_files(lines):
    df = lines("a--b <script>", "ok", file_id="a").unionByName(lines("ok", file_id="b"))
    (row,) = parse.scan_summary(df).collect()
    assert tuple(row) == (2, 1, 2)


def test_report_caps(lines):
    one = lines(*["a--b"] * 30, file_id="a")
    rows = runs.scan_report(one).collect()
    assert len(rows) == 5 and {(r["file_findings"], r["more"]) for r in rows} == {(30, 25)}
    many = one
    for name in "bcdef":
        many = many.unionByName(lines(*["a--b"] * 7, file_id=name))
    rows = runs.scan_report(many).collect()
    assert len(rows) == 20
    assert sorted({r["file_id"] for r in rows}) == ["a", "b", "c", "d"]


def test_exclusions_compare_whole_segments(spark):
    rows = [("1", "/cv-data/processed/staging/a.log"), ("2", "/p/cv/b.log"), ("3", "/p/app_log/.c"),
            ("4", "/p/other_document/d.log"), ("5", "/p/reports/e.log")]
    files = spark.createDataFrame(rows, "file_id string, path string")

    def ids(df):
        return sorted(r["file_id"] for r in df.collect())

    assert ids(parse.scan_exclusions(files)) == ["1", "4", "5"]
    assert ids(parse.scan_exclusions(files, api=True)) == ["1", "5"]


def test_scan_plan_is_one_stage_without_shuffle(lines):
    plan = parse.extract_events(lines("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
