import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from logmill.llm import bpe  # noqa: E402
from logmill.llm.common import rank_path  # noqa: E402
from tests.llm.helpers import ODD, documents  # noqa: E402

PATTERN = regex.compile(public_tokenizers.PATTERN)
MARKS = ["a", "Z", "é", "漢", "1", "²", "'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", " ", "　", "!", "_", "😀", "\x1c"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_path()), special_tokens={}
    )


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MARKS), max_size=20).map("".join), min_size=1, max_size=5))
def test_words_are_those_of_the_pattern(texts):
    words, counts = bpe.split_words(pa.array(texts, pa.string()))
    expected = [PATTERN.findall(t) for t in texts]
    assert words.to_pylist() == [w for row in expected for w in row] and counts.tolist() == [len(e) for e in expected]


ROWS = [*ODD, *((i, f" The{'re' * (i % 5)}fore, it's {i * 37}?!\n\n  x") for i in range(20, 60))]


def test_ids_and_decoded_text(spark, encoding, monkeypatch):
    docs = documents(spark, ROWS).selectExpr("*", "1 AS block", "'x' AS word", "2 AS ids")
    found = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"]).decode()) for r in bpe.encode_texts(docs, rank_path()).collect()), key=str)
    assert found == sorted(((i, encoding.encode_ordinary(t or ""), t or "") for i, t in ROWS), key=str)


def test_digests(spark, encoding):
    found = bpe.encode_texts(documents(spark, ROWS), rank_path(), ("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    expected = []
    for i, t in ROWS:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)
    assert bpe.encode_texts(documents(spark, []), rank_path()).count() == 0


def test_plans_do_not_hold_the_ranks(spark):
    plans = bpe.encode_texts(documents(spark, ROWS), rank_path())._jdf.queryExecution()
    assert len(plans.toString()) < 100_000
    assert " AS maps#" not in plans.optimizedPlan().toString()  # nor do rows


def test_packing():
    values = np.array([0, 1, 255, 256, 70_000, 2**31])
    assert bpe.unpack(bpe.pack(values)).tolist() == values.tolist()
    assert bpe.unpack(bpe.pack(np.zeros(0))).tolist() == []
    words = ["", " é", "😀" * 3]
    assert bpe.unpack_words(*bpe.pack_words([w.encode() for w in words])) == words
