import os

import pytest

import corpus_pipeline
from logmill.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import documents

COLUMNS = {
    "op1_simhash": "component_id doc_id fingerprint",
    "op2_line_dedup": "deleted_lines deleted_runs doc_id kept_chars kept_sha256",
    "op3_exact_dedup": "doc_id group_size keep_id kept text_sha256",
    "op4_html_text": "page_id text url",
    "op5_fingerprint": "doc_id edited_fingerprint edited_sha256 fingerprint n_chars near_edited near_next",
    "op6_toxicity": "doc_id held_out predicted score",
    "op7_ppm": "base_score doc_id held_out n_known n_tokens score train_tokens",
    "op8_quality": "doc_id held_out predicted score",
    "op9_byte_bpe": "decoded_sha256 doc_id ids_sha256 n_tokens",
    "op10_mixing": "copies doc_id domain probability rate tokens",
    "op11_divergence": "item lang part rank source value",
    "op12_packing": "doc_id ids_crc32 length offset piece sequence_id start",
    "op13_repair": "audit blank conv_id cost duplicate gaps illegal repaired_sha256 truncated",
}
ONE_ROW_EACH = [name for name in sorted(COLUMNS) if name[:4] not in ("op11", "op12", "op13")]


def test_all_are_registered():
    assert set(QUERIES) == {*COLUMNS, "pipeline"}
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_rows_and_columns(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    table = "pages" if name.startswith("op4") else "documents"
    assert sorted(found.columns) == COLUMNS[name].split()
    assert found.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name_ in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{sf_dir}/{name_}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(str([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(str([row[c] for c in columns]) for row in found.collect()) == theirs


def test_pipeline_stages(spark, tmp_path):
    """Planted cases go, clean documents stay, columns hold."""
    clean = [(i, " ".join(f"c{i}w{k}" for k in range(80))) for i in range(120)]
    insults = [(1000 + i, " ".join(f"t{i}w{k}" for k in range(30)) + " utterscumbag fool") for i in range(60)]
    passage = " ".join(f"pass{k}" for k in range(70))
    shared = [(2000 + i, f"own start {i} alpha\n{passage}\nown end {i} omega") for i in range(4)]
    base = [f"n{k}" for k in range(3000)]
    near = [(3000 + i, " ".join(["changed" if k == 40 + i else w for k, w in enumerate(base)])) for i in range(5)]
    rows = [*clean, *insults, *shared, *near, (4000, clean[0][1]), (4001, None), (4002, "")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, i % 2, 1) for i, _ in insults]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if number < 4:
            assert out.columns == docs.columns
        path = f"{tmp_path}/{number}.parquet"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        ids.append({r["doc_id"] for r in now.collect()})
        if name == "line dedup":
            texts = {r["doc_id"]: r["text"] for r in now.collect()}
            assert sum(passage in (t or "") for t in texts.values()) == 1
            assert texts[2001] == "own start 1 alpha\nown end 1 omega"
    assert ids[0] == {i for i, _ in rows} - {i for i, _ in insults}
    assert ids[1] == ids[0]
    assert {i for i, _ in clean} <= ids[2]
    assert len(ids[2] & set(range(3000, 3005))) == 1
    assert ids[4] == ids[3] == ids[2]


def test_pipeline_query(spark, sf_dir):
    found = QUERIES["pipeline"](spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids", "decoded_sha256"} == set(found.columns) and found.count() > 0


def test_nothing_else_imports_the_folder():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "logmill")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as source:
                    assert "logmill.llm" not in source.read(), name
