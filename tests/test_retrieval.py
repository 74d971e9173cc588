import numpy as np
import pytest
from pyspark.sql import functions as F

from logmill.operators import retrieval


@pytest.mark.parametrize("length, starts", [(0, []), (1, [0]), (900, [0]), (901, [0, 900]), (1000, [0, 900]), (1901, [0, 900, 1800])])
def test_chunks(spark, length, starts):
    text = "".join(chr(97 + i % 26) for i in range(length))
    df = spark.createDataFrame([("f", text)], "file_id string, text string")
    rows = retrieval.chunk_text(df).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == [text[s : s + 1000] for s in starts]
    assert "".join(r["text"][:900] for r in rows[:-1]) + (rows[-1]["text"] if rows else "") == text


@pytest.mark.parametrize("size, step, block_lines", [(1000, 900, 4096), (7, 5, 2), (10, 10, 3)])
def test_pieces_from_lines_are_those_of_whole_texts(spark, size, step, block_lines):
    rng = np.random.default_rng(size)
    texts = ["", "\n", "a", "\n\n\nb", "é" * 40, "one\n\ntwo\n"] + [
        "\n".join("w" * int(n) for n in rng.integers(0, 30, rng.integers(1, 40))) for _ in range(12)
    ]
    lines = [(f"f{i}", k, line) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n"), start=1)]
    frame = spark.createDataFrame(lines, "file_id string, line_no long, line string").repartition(5)
    whole = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_id string, text string")
    found = {(r["file_id"], r["chunk_index"]): r["text"] for r in retrieval.chunk_lines(frame, size, step, block_lines).collect()}
    assert found == {(r["file_id"], r["chunk_index"]): r["text"] for r in retrieval.chunk_text(whole, size, step).collect()}
    sampled = {r["file_id"]: r["text"] for r in retrieval.sample_lines(frame, size, block_lines).collect()}
    assert sampled == {f"f{i}": t if len(t) <= 2 * size else t[:size] + t[-size:] for i, t in enumerate(texts) if t}


def unit(rng, n, dim=6):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(4)
    docs, queries = unit(rng, 200), unit(rng, 3)
    docs[150] = docs[10]  # a tie: the lower id wins
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(docs)]
    return (
        docs,
        queries,
        spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(5),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>"),
    )


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def expected(docs, queries, k, metric, keep=lambda i: True):
    out = {}
    for j, q in enumerate(queries):
        s = [(round(float(-((d - q) ** 2).sum()) if metric == "l2" else float(d @ q), 6), i) for i, d in enumerate(docs) if keep(i)]
        out[j] = [(i, v) for v, i in sorted(s, key=lambda t: (-t[0], t[1]))[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_against_brute_force(space, metric):
    docs, queries, d, q = space
    assert got(retrieval.topk_similar(d, q, 7, metric)) == expected(docs, queries, 7, metric)


@pytest.mark.parametrize("doc_rows, query_rows", [(1 << 16, 1 << 14), (30, 1), (7, 2)])
def test_where_and_tiles(space, doc_rows, query_rows):
    docs, queries, d, q = space
    found = retrieval.topk_similar(d, q, 3, where={"label": 2}, doc_rows=doc_rows, query_rows=query_rows)
    assert got(found) == expected(docs, queries, 3, "cosine", lambda i: i % 4 == 2)


def test_many_questions_in_one_pass(spark, space):
    """20,000 questions: nothing runs before the result is asked for, nothing is collected."""
    docs, _, d, _ = space
    rng = np.random.default_rng(8)
    queries = unit(rng, 20_000)
    flat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    spark.sparkContext.setJobGroup("lazy", "no job yet")
    found = retrieval.topk_similar(d, flat, 3)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    some = found.where("query_id % 4001 = 0").orderBy("query_id", "rank").collect()
    picked = list(range(0, 20_000, 4001))
    exact = expected(docs, queries[picked], 3, "cosine")
    assert [(r["id"], r["score"]) for r in some] == [x for j in range(len(picked)) for x in exact[j]]
    assert found.count() == 60_000


def test_fewer_documents_than_asked_for_and_no_questions(space):
    docs, queries, d, q = space
    assert len(got(retrieval.topk_similar(d.where("id < 2"), q, 5))[0]) == 2
    none = retrieval.topk_similar(d, q.where("query_id < 0"), 5)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "id", "score"]
    with pytest.raises(ValueError):
        retrieval.topk_similar(d, q, metric="dot")


def test_hash_buckets_recall(spark):
    """Nine in ten of the exact neighbours of vectors in clusters; scores are exact."""
    rng = np.random.default_rng(4)
    centres = unit(rng, 60, 24)
    docs = (centres[:, None, :] + rng.normal(0, 0.05, size=(60, 50, 24))).reshape(-1, 24)
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    queries = centres[:40] + rng.normal(0, 0.05, size=(40, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    exact = expected(docs, queries, 5, "l2")
    found = retrieval.topk_similar_lsh(d, q, 5)
    held = got(found)
    hits = [len({i for i, _ in exact[j]} & {i for i, _ in held.get(j, [])}) / 5 for j in exact]
    assert np.mean(hits) >= 0.9
    scores = {(j, i): v for j in held for i, v in held[j]}
    assert all(abs(scores[(j, i)] - v) < 1e-5 for j in exact for i, v in exact[j] if (j, i) in scores)
    recall = {r["query_id"]: r["recall"] for r in retrieval.with_recall(found, retrieval.topk_similar(d, q, 5, "l2")).collect()}
    assert all(recall[j] == pytest.approx(hits[j], abs=1e-6) for j in recall)


def test_hash_buckets_hold_a_bounded_share(spark):
    """Few of the documents are compared: ids meet only in buckets near a question's."""
    assert [retrieval.hash_bits(n) for n in (0, 63, 64, 128, 6400, 64 << 20)] == [1, 1, 1, 2, 7, 21]
    rays = retrieval.directions(16, 12, 8).reshape(-1, 16)
    unit_rays = rays / np.linalg.norm(rays, axis=1, keepdims=True)
    assert np.abs(np.corrcoef(unit_rays) - np.eye(96)).mean() < 0.3
    none = spark.createDataFrame([], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert retrieval.topk_similar_lsh(none, q).count() == 0


def test_documents_of_five_collections(spark):
    one = spark.createDataFrame([("f", "sum")], "file_id string, summary string")
    chunks = spark.createDataFrame([("f", 0, "t0")], "file_id string, chunk_index int, text string")
    events = spark.createDataFrame([("f", 3, 0, "ERROR", "m", None)], "file_id string, line_no long, category_no int, entry_type string, message string, logged_on string")
    vulns = events.withColumns({"category_no": F.lit(2), "vuln_type": F.lit("X"), "solution": F.lit("do"), "severity": F.lit("High"), "reference_url": F.lit("u")})
    master = spark.createDataFrame([("f", "o.log", "c", "s", "Processed")], "file_id string, original_filename string, category string, summary string, status string")
    docs = retrieval.index_docs(one, chunks, events, vulns, master)
    rows = {r["collection"]: r for r in docs.collect()}
    assert {c: r["id"] for c, r in rows.items()} == {
        "summaries": "summary_f", "chunks": "chunk_f_0", "events": "f_event_3_0", "vulnerabilities": "f_vuln_3_2", "metadata": "f_metadata"}
    assert rows["events"]["text"] == "[ERROR] m" and rows["events"]["timestamp"] == ""
    assert rows["vulnerabilities"]["text"] == "[X] m\nSolution: do"
    assert rows["metadata"]["text"] == "File: o.log\nCategory: c\nSummary: s\nStatus: Processed"
    assert {r["collection"]: r["n"] for r in retrieval.collection_stats(docs).collect()}["chunks"] == 1
    assert [r["id"] for r in retrieval.collection_head(docs, "chunks").collect()] == ["chunk_f_0"]


def test_upsert_keeps_the_newest(spark):
    schema = "collection string, id string, text string, version int"
    old = spark.createDataFrame([("c", "1", "a", 1), ("c", "2", "b", 1), ("d", "1", "z", 1)], schema)
    new = spark.createDataFrame([("c", "1", "a2", 2), ("c", "1", "a3", 3), ("c", "3", "n", 2)], schema)
    rows = {(r["collection"], r["id"]): r["text"] for r in retrieval.upsert_docs(old, new).collect()}
    assert rows == {("c", "1"): "a3", ("c", "2"): "b", ("c", "3"): "n", ("d", "1"): "z"}


def test_context(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    schema = "id string, file_id string, text string, embedding array<double>"
    s = spark.createDataFrame([("a", "fa", "near", [1.0, 0.1]), ("b", "fb", "far", [0.0, 1.0])], schema)
    c = spark.createDataFrame([("c", "fc", "body", [1.0, 0.0])], schema)
    (row,) = retrieval.retrieval_context(s, c, q, k=1).collect()
    assert row["context"] == (
        "=== Log File Summaries ===\n\nFile: fa\nSummary: near\n\n=== Relevant Log Details ===\n\nFile: fc\nContent: body")
    (row,) = retrieval.retrieval_context(s.limit(0), c.limit(0), q).collect()
    assert row["context"] == "No log data indexed yet."
    (row,) = retrieval.search_report(s, q, "Summary").collect()
    assert row["report"] == "File: fa\nSummary: near\n---\nFile: fb\nSummary: far"
