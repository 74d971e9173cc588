import hashlib

import pytest
from pyspark.sql import functions as F

from logmill.llm import dedup_stream
from tests.llm.helpers import ODD, documents


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def weak(text):
    """Few digests, so that different texts collide."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 1)


ROWS = [*ODD, *((i, f"Text {i % 9}") for i in range(20, 80)), (90, "tEXT 3"), (91, "ÄPFEL"), (92, "äpfel")]


def check(rows, found):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    least = -(10**9)
    expected = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: least if i is None else i)
        expected += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("digest, files", [(dedup_stream.sha256_hex, None), (weak, 1)])
def test_groups(spark, tmp_path, digest, files):
    path = f"{tmp_path}/documents.parquet"
    documents(spark, ROWS).selectExpr("*", "'x' AS digest", "1 AS n", "2 AS place", "3 AS file").write.parquet(path)
    check(ROWS, dedup_stream.exact_duplicates(spark, path, digest, files).collect())


def test_goes_on_where_it_stopped(spark, tmp_path):
    path, folder = f"{tmp_path}/documents.parquet", f"{tmp_path}/state"
    documents(spark, ROWS[:30]).write.parquet(path)
    check(ROWS[:30], dedup_stream.exact_duplicates(spark, path, folder=folder).collect())
    documents(spark, ROWS[30:]).write.mode("append").parquet(path)
    check(ROWS, dedup_stream.exact_duplicates(spark, path, folder=folder).collect())


def test_empty(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    documents(spark, []).write.parquet(path)
    found = dedup_stream.exact_duplicates(spark, path)
    assert found.count() == 0 and found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
