import pytest
from pyspark.sql import functions as F

from logmill.functions.expr import safe_name
from logmill.operators import metadata

MASTER = """id long, file_id string, original_filename string, stored_filename string, raw_storage_path string,
final_path string, category string, cluster_id string, summary string, status string, created_on string"""


def master(spark, *names, **over):
    rows = [
        (i, f"F{i}", original, stored, f"raw/{i}", over.get("final", "Pending"), "Pending", "N/A", "N/A", "Success", f"2024-01-0{i}")
        for i, (original, stored) in enumerate(names, start=1)
    ]
    return spark.createDataFrame(rows, MASTER)


CHAIN = [("a.log", "u1"), ("b.log", "u2"), ("u1", "u3"), ("u3", "u4"), ("a.log", "u9")]


def test_chain_ends(spark):
    got = {r["id"]: r["end_id"] for r in metadata.chain_ends(master(spark, *CHAIN)).collect()}
    assert got == {1: 4, 2: 2, 3: 4, 4: 4, 5: 5}


def test_long_chain_and_traps(spark):
    names = [(f"n{i}", f"n{i + 1}") for i in range(1, 10)]
    got = {r["id"]: r["end_id"] for r in metadata.chain_ends(master(spark, *names)).collect()}
    assert set(got.values()) == {9}
    odd = [("x", "N/A"), ("N/A", "q"), ("y", "y"), ("z", "x")]  # no name, itself, an earlier row
    got = {r["id"]: r["end_id"] for r in metadata.chain_ends(master(spark, *odd)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize(
    "asked, end, path", [("a.log", 5, "raw/5"), ("B.LOG", 2, "raw/2"), ("u1", 4, "raw/4"), (".log", 5, "raw/5")]
)
def test_resolve_one(spark, asked, end, path):
    (row,) = metadata.resolve_path(master(spark, *CHAIN), asked).collect()
    assert (row["end_id"], row["path"]) == (end, path)


def test_resolve_unknown_and_literal_dot(spark):
    assert metadata.resolve_path(master(spark, *CHAIN), "a?log").count() == 0
    assert metadata.resolve_path(master(spark, ("axlog", "u")), "a.log").count() == 0


def test_final_path_is_preferred(spark):
    (row,) = metadata.resolve_path(master(spark, ("a", "u"), final="done/a"), "a").collect()
    assert row["path"] == "done/a"


def test_insert_update_list_round_trip(spark):
    table = master(spark, ("a.log", "u1"))
    new = master(spark, ("zzz", "u1"), ("b.log", "u2")).where("id <= 2")
    once = metadata.insert_if_absent(table, new, "file_id", ["id"])
    assert sorted(r["original_filename"] for r in once.collect()) == ["a.log", "b.log"]
    assert metadata.insert_if_absent(once, new, "file_id", ["id"]).count() == 2
    updates = spark.createDataFrame(
        [("u1", "x", "p", "1", "old", 1), ("u1", "app_log", "p2", "2", "Test summary", 2), ("nobody", "x", "p", "1", "s", 1)],
        "stored_filename string, category string, final_path string, cluster_id string, summary string, update_no int",
    )
    rows = {r["file_id"]: r for r in metadata.update_by_name(once, updates).collect()}
    assert (rows["F1"]["category"], rows["F1"]["status"], rows["F1"]["summary"]) == ("app_log", "Processed", "Test summary")
    assert (rows["F2"]["category"], rows["F2"]["status"]) == ("Pending", "Success")
    listed = metadata.list_files(metadata.update_by_name(once, updates), status="Processed").collect()
    assert [r["file_id"] for r in listed] == ["F1"]
    assert [r["file_id"] for r in metadata.list_files(once, limit=1).collect()] == ["F2"]


def test_missing_columns_are_null(spark):
    table = spark.createDataFrame([("a", "x")], "file_id string, summary string")
    new = spark.createDataFrame([("b",)], "file_id string")
    rows = {r["file_id"]: r["summary"] for r in metadata.insert_if_absent(table, new, "file_id", ["file_id"]).collect()}
    assert rows == {"a": "x", "b": None}


@pytest.mark.parametrize("strict, status", [(False, "Routed"), (True, "Failed")])
def test_profile(spark, lines, strict, status):
    files = spark.createDataFrame(
        [("f.log", "f.log", "u.log", "staging/u.log", 1536, True), ("e", "Email x.log", "e", "s/e", 10, True),
         ("a", "API.csv", "a", "s/a", 10, False), ("c", "cv.pdf", "c", "cv/c", 10, False)],
        "file_id string, name string, stored_name string, path string, size_bytes long, staged boolean",
    )
    rows = {r["file_id"]: r for r in metadata.profile_files(files, lines("x", "y"), strict).collect()}
    assert (rows["f.log"]["row_count"], rows["f.log"]["file_size_kb"], rows["f.log"]["status"]) == (2, 1.5, "Success")
    assert rows["e"]["source_type"] == "Email Attachment"
    assert (rows["a"]["source_type"], rows["a"]["stored_filename"], rows["a"]["status"]) == ("External API", "N/A", "Success")
    assert (rows["c"]["status"], rows["c"]["raw_storage_path"], rows["c"]["row_count"]) == (status, "N/A", 0)


def test_cascade_delete(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file_id string, x int")
    left = metadata.cascade_delete({"one": t, "two": t}, spark.createDataFrame([("a",), ("a",)], "file_id string"))
    assert [left[k].count() for k in ("one", "two")] == [1, 1]


def test_ids_and_names(spark):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    df = spark.createDataFrame([(f"{u}_x.log", "p1"), (f"pic-{u}.png", "p2"), ("a.log", "p3")], "name string, path string")
    rows = {r["name"]: (r["file_id"], r["event_file_id"]) for r in metadata.file_ids(df).collect()}
    assert rows[f"{u}_x.log"] == (u, u)
    assert rows[f"pic-{u}.png"] == (u, f"pic-{u}.png")
    assert rows["a.log"][0].startswith("AUDIT-") and rows["a.log"][1] == "a.log"
    df = spark.createDataFrame([(" a/b<c>é_1-2 .log ",)], "name string")
    assert df.select(safe_name(F.col("name")).alias("s")).first()["s"] == "abcé_1-2 .log"


def test_recent(spark):
    df = spark.createDataFrame([("f", i, f"2024-01-{i:02d}") for i in range(1, 9)], "file_id string, line_no int, created_on string")
    assert [r["line_no"] for r in metadata.recent_rows(df).collect()] == [8, 7, 6, 5, 4]


def test_following_names_reaches_the_ends_of_all_chains(spark):
    """The frontier search agrees with the doubling over all rows; only rows reached are joined."""
    rows = [(i, f"n{i}", f"n{i + 1}") for i in range(1, 9)]  # one chain
    rows += [(20, "a", "b"), (21, "b", "a"), (22, "a", "c"), (23, "b", "c"), (24, "c", "N/A"), (25, "d", "d"), (26, "e", "gone")]
    master = spark.createDataFrame(rows, "id long, original_filename string, stored_filename string")
    ends = {r["id"]: r["end_id"] for r in metadata.chain_ends(master).collect()}
    starts = master.select(F.col("id").cast("string").alias("name"), "id")
    found = {int(r["name"]): r["end_id"] for r in metadata.follow_names(master, starts).collect()}
    assert found == ends and found[1] == 8 and found[21] == 24
    sizes = []
    written = metadata.round_tables

    def counted(session, name):
        write = written(session, name)

        def note(df):
            out = write(df)
            sizes.append(out.count())
            return out

        return note

    metadata.round_tables = counted
    try:
        one = metadata.follow_names(master, starts.where("id = 1")).collect()
    finally:
        metadata.round_tables = written
    assert [(r["name"], r["end_id"]) for r in one] == [("1", 8)]
    assert sizes == [1] * 8 + [0]
    assert metadata.follow_names(master, starts.limit(0)).count() == 0


def test_listings_without_a_limit(spark):
    rows = [(f"f{i}", "o", "c", "Processed", i) for i in range(150)]
    master = spark.createDataFrame(rows, "file_id string, original_filename string, category string, status string, created_on int")
    assert metadata.list_files(master).count() == 150 and metadata.list_files(master, limit=7).count() == 7


def test_one_name_never_shuffles_the_names_on_record(spark, tmp_path):
    """Each step of a chain broadcasts the few names it has reached."""
    rows = [(i, f"s-{i - 1}", f"s-{i}") for i in range(1, 5)] + [(100 + i, f"o-{i}", f"p-{i}") for i in range(40)]
    spark.createDataFrame(rows, "id long, original_filename string, stored_filename string").write.parquet(str(tmp_path / "m"))
    master = spark.read.parquet(str(tmp_path / "m"))
    joins = []

    def plan(df, name):
        if name == "reached":
            joins.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    plain = metadata.materialize
    metadata.materialize = plan
    try:
        ends = metadata.follow_names(master, spark.createDataFrame([("a", 1), ("b", 105)], "name string, id long"))
        assert {(r["name"], r["end_id"]) for r in ends.collect()} == {("a", 4), ("b", 105)}
    finally:
        metadata.materialize = plain
    assert len(joins) == 4 and not any("SortMergeJoin" in j for j in joins)
