"""Sources, sinks and the directory stream on real files."""

import pytest
from pyspark.sql import functions as F

from logmill.operators import enrich, metadata, parse
from logmill.session import materialize, scratch_path, shared_dir
from logmill.sources import folders, readers, sinks
from logmill.streaming import streams


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for name in ("a", "b"):
        text = "".join(f"{name} line {i}\n" for i in range(1, 3001))
        (folder / f"{name}.log").write_text(text)
    (folder / "c.txt").write_bytes(b"x\r\nERROR bad \xff byte\r\n\r\nend")
    (folder / "empty.log").write_text("")
    return folder


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "8000", "spark.sql.files.openCostInBytes": "500"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_line_numbers_across_blocks(spark, landing, small_splits, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    df = readers.read_log_lines(spark, str(landing))
    for name in ("a", "b"):
        rows = {r["line_no"]: r["line"] for r in df.where(F.col("name") == f"{name}.log").collect()}
        assert rows == {i: f"{name} line {i}" for i in range(1, 3001)}
    rows = {r["line_no"]: r["line"] for r in df.where("name = 'c.txt'").collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {1: "x", 2: "ERROR bad � byte", 3: "", 4: "end"}


def test_lines_of_texts_agree(spark, landing):
    texts = readers.read_texts(spark, str(landing)).where("name <> 'c.txt'")
    lines = readers.lines_of_texts(texts, "file_id")
    read = readers.read_log_lines(spark, str(landing)).where("name <> 'c.txt'")
    assert lines.exceptAll(read.select("file_id", "line_no", "line")).count() == 0
    assert lines.count() == read.count() == 6000


def test_folder_listing_names_every_file(spark, landing, monkeypatch):
    for folder in ("cv", "deep/er/still", "deep/cv"):
        (landing / folder).mkdir(parents=True, exist_ok=True)
        (landing / folder / "me.txt").write_text("x")
    (landing / ".hidden").write_text("x")
    (landing / "_odd name.log").write_text("xy")
    own = [".hidden", "_odd name.log", "a.log", "b.log", "c.txt", "empty.log"]
    listed = {r["name"]: r for r in readers.list_landing_files(spark, str(landing)).collect()}
    assert sorted(listed) == own
    assert (listed["empty.log"]["size_bytes"], listed["_odd name.log"]["size_bytes"]) == (0, 2)
    assert listed["a.log"]["path"] == f"file:{landing}/a.log" and listed["a.log"]["modified"].year > 2020
    every = readers.list_landing_files(spark, f"file://{landing}", recursive=True)
    assert sorted(r["name"] for r in every.collect()) == sorted([*own, "me.txt", "me.txt", "me.txt"])
    both = readers.list_landing_files(spark, [str(landing / "cv"), str(landing / "deep")], recursive=True)
    assert both.count() == 3
    targets = readers.walk_scan_targets(spark, str(landing))
    assert sorted(r["name"] for r in targets.collect()) == ["_odd name.log", "a.log", "b.log", "c.txt", "empty.log", "me.txt"]
    many, few = folders.FolderReader(str(landing), True), {"below": 0}
    assert [p.below for p in many.partitions()] == [False] * 6
    monkeypatch.setattr(folders, "FOLDERS", 3)
    few = many.partitions()
    assert [p.below for p in few] == [False, True, True]
    assert sorted(r[1] for p in few for r in many.read(p)) == sorted([*own, "me.txt", "me.txt", "me.txt"])


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "app.log").write_text(f"ERROR in {folder}\nok\n")
    (tmp_path / "x" / "table.csv").write_text("no,log\n")
    lines = readers.read_log_lines(spark, str(tmp_path))
    assert parse.scan_summary(lines).first()["files_scanned"] == 2
    assert sorted((r["name"], r["line_no"]) for r in lines.collect()) == [("app.log", n) for n in (1, 1, 2, 2)]
    found = enrich.dedupe_incidents(parse.extract_events(lines))
    assert sorted(r["message"] for r in found.collect()) == ["ERROR in x", "ERROR in y"]


def test_quotes_commas_and_line_ends(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"he said ""hi"", ok"\n2,"two\nlines"\n')
    df = readers.read_csv_table(spark, str(tmp_path / "q.csv"), "a int, b string", multiline=True)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'he said "hi", ok'), (2, "two\nlines")]


def test_csv_and_parquet(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Date first seen,Src IP,Packets\n2024-01-01 10:00:00,10.0.0.1,5\n")
    df = readers.read_csv_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"Date first seen": "timestamp", "Src IP": "string", "Packets": "int"}
    df.write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet_table(spark, str(tmp_path / "p")).collect() == df.collect()


def test_old_report(spark, tmp_path):
    (tmp_path / "m.csv").write_text("file_id,status\nF1,Old\nF2,Old\nF2,Older\n")
    master = spark.createDataFrame([("F1", "New")], "file_id string, status string")
    rows = {r["file_id"]: r["status"] for r in readers.load_master_csv(spark, str(tmp_path / "m.csv"), master).collect()}
    assert rows == {"F1": "New", "F2": "Old"}


def test_sinks(spark, tmp_path, lines):
    df = lines("a", "b,\"c\"\nd", "e").withColumn("category", F.when(F.col("line") == "a", "x").otherwise("y"))
    sinks.write_by_category(df, str(tmp_path / "k1"))
    assert spark.read.parquet(str(tmp_path / "k1" / "category=y")).count() == 2
    rows = df.select(F.col("line").alias("original_log"), F.col("file_id").alias("source_file"), F.lit("c").alias("cleaned_log"), F.lit(1).alias("cluster_id"), "category")
    sinks.write_lines_by_category(rows.where("cluster_id = 1"), str(tmp_path / "k3"))
    back = spark.read.csv(str(tmp_path / "k3"), header=True, escape='"', multiLine=True)
    assert sorted(r["original_log"] for r in back.collect()) == ["a", "b,\"c\"\nd", "e"]
    report = df.select(F.col("file_id").alias("file_name"), F.lit('s, "q"').alias("summary"), F.lit(2).alias("cluster_id"), "category")
    sinks.write_cluster_report(report, str(tmp_path / "k2"))
    assert spark.read.csv(str(tmp_path / "k2"), header=True, escape='"').first()["summary"] == 's, "q"'


def test_event_tables(spark, tmp_path, lines):
    vulns, others = parse.split_vulns(parse.extract_events(lines("error", "a--b")))
    unresolved = enrich.unified_events(
        enrich.fallback_incident_resolution(others).withColumn("severity", F.lit(None).cast("string")),
        enrich.fallback_vuln_resolution(vulns),
    )
    for _ in range(2):
        sinks.append_events(unresolved, str(tmp_path / "ev"))
    rows = spark.read.parquet(str(tmp_path / "ev")).collect()
    assert len(rows) == 4 and {r["severity"] for r in rows} == {"Medium", "High"}
    assert all(r["created_by"] == r["updated_by"] and r["created_on"] for r in rows)
    sinks.append_vulns(enrich.fallback_vuln_resolution(vulns).withColumn("severity", F.lit(None).cast("string")), str(tmp_path / "vu"))
    (row,) = spark.read.parquet(str(tmp_path / "vu")).collect()
    assert row["severity"] is None and row["analyzed_on"] is not None


def test_replacing_a_table_with_a_version_of_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "file_id string, x int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(path)
    table = spark.read.parquet(path)
    new = spark.createDataFrame([("b", 9), ("c", 3)], schema)
    sinks.replace_table(metadata.insert_if_absent(table, new, "file_id"), path)
    assert {r["file_id"]: r["x"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2, "c": 3}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.log").write_text("ok\n2024-01-01 10:00:00 ERROR x\n")

    def run():
        streams.stream_events(streams.log_stream(spark, str(folder)), out, state).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 1
    assert run() == 1
    (folder / "b.log").write_text("a--b\nwarn")
    assert run() == 3
    batch = parse.extract_events(readers.read_log_lines(spark, str(folder)).select("file_id", "line_no", "line"))
    assert spark.read.parquet(out).drop("batch").exceptAll(batch).count() == 0


def test_stream_state(spark, tmp_path):
    folder = tmp_path / "ev"
    rows = [("f", "ERROR", "m", "2024-01-01 10:00:00"), ("f", "ERROR", "m", "2024-01-01 10:05:00"), ("f", "WARNING", "m", "2024-01-01 11:00:00"), ("g", "ERROR", "n", "2024-01-01 15:00:00")]
    schema = "file_id string, entry_type string, message string, t string"
    df = spark.createDataFrame(rows, schema).withColumn("logged_ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(folder))

    def run(transform, mode, name):
        stream = spark.readStream.schema(df.schema).parquet(str(folder))
        query = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    assert len(run(streams.stream_dedupe, "append", "deduped")) == 3


def test_hourly_counts_over_batches_a_restart_and_late_rows(spark, tmp_path):
    folder, out, state = tmp_path / "ev", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "file_id string, logged_ts timestamp"

    def add(*times):
        rows = spark.createDataFrame([("f", t) for t in times], "file_id string, t string")
        rows.select("file_id", F.to_timestamp("t").alias("logged_ts")).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        streams.write_updates(streams.stream_hourly(stream), out, state).awaitTermination()
        return {r["hour_start"].hour: r["events"] for r in streams.hourly_totals(spark, out).collect()}

    add("2024-01-01 10:00:00", "2024-01-01 10:05:00")
    add("2024-01-01 11:00:00")
    assert run() == {10: 2, 11: 1}
    add("2024-01-01 10:59:00", "2024-01-01 15:00:00")  # an hour late at most
    assert run() == {10: 3, 11: 1, 15: 1}
    add("2024-01-01 10:30:00", "2024-01-01 15:30:00")  # the first is four hours late
    assert run() == {10: 3, 11: 1, 15: 2}


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    df = materialize(spark.range(3), "range")
    assert df.count() == 3 and all(shared_dir(spark) in f for f in df.inputFiles())


def test_many_folders_are_dealt_to_few_partitions(tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "FOLDERS", 4)
    for i in range(30):
        (tmp_path / f"f{i}" / "in").mkdir(parents=True)
        (tmp_path / f"f{i}" / "in" / f"{i}.log").write_text("x")
    reader = folders.FolderReader(str(tmp_path), True)
    parts = reader.partitions()
    assert len(parts) == 5
    assert sorted(r[1] for p in parts for r in reader.read(p)) == sorted(f"{i}.log" for i in range(30))
