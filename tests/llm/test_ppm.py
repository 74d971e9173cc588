import math
import zlib
from collections import Counter, defaultdict

import pytest

from logmill.llm import ppm
from logmill.llm.common import remainder_is
from tests.llm.helpers import ODD, documents, table_of


def lowered(text):
    return (text or "").encode().lower()


def plain_scores(rows):
    """By the definition: nested contexts, escapes of method C, exclusion."""
    train = [lowered(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    words = Counter()
    for text in train:
        words.update([*text.split(), None])
        marked = b"\xff" * ppm.ORDER + text + b"\xff"
        for at in range(ppm.ORDER, len(marked)):
            for k in range(ppm.ORDER + 1):
                counts[k][marked[at - k : at]][marked[at]] += 1
    total, distinct = sum(words.values()), len(words)

    def log_p(context, byte):
        excluded, log = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            left = {b: n for b, n in counts[k].get(context[ppm.ORDER - k :], {}).items() if b not in excluded}
            if left:
                whole = sum(left.values()) + len(left)
                if byte in left:
                    return log + math.log10(left[byte] / whole)
                log += math.log10(len(left) / whole)
                excluded |= set(left)
        return log - math.log10(256 - len(excluded))

    out = []
    for i, t in rows:
        text = lowered(t)
        marked = b"\xff" * ppm.ORDER + text + b"\xff"
        tokens = [*text.split(), None]
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in tokens)
        score = sum(log_p(marked[k - ppm.ORDER : k], marked[k]) for k in range(ppm.ORDER, len(marked)))
        out.append((i, len(tokens), sum(words[w] > 0 for w in tokens), total, base, score))
    return out


def check(spark, rows, tmp_path, **extra):
    docs = table_of(spark, documents(spark, rows).selectExpr("*", "1 AS block", "2 AS code", "true AS train"), tmp_path)
    found = ppm.ppm_scores(docs, remainder_is("doc_id", 7, 2)).collect()
    got = sorted(
        ((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found),
        key=lambda r: (str(r[0]), r[5]),
    )
    want = sorted(plain_scores(rows), key=lambda r: (str(r[0]), r[5]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], rel=1e-6)  # probabilities travel with seven digits


def test_against_the_definition(spark, tmp_path, monkeypatch):
    rows = [(i, f"The river {'runs ' * (i % 4)}over stone {i % 11}\n and Rests{i}") for i in range(60)]
    check(spark, [*rows, *[r for r in ODD if r[0] != 6]], tmp_path)


def test_several_blocks_and_parts(spark, tmp_path):
    import pyarrow as pa

    texts = ["ab " * 50, "", "xyz"] * 20
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(60)), pa.array(texts), pa.array([True] * 60), pa.array([3] * 60)], ["doc_id", "text", "train", "partition"]
    )
    old = ppm.BLOCK, ppm.PART
    ppm.BLOCK, ppm.PART = 1000, 300
    try:
        found = list(ppm._blocks(iter([batch])))
    finally:
        ppm.BLOCK, ppm.PART = old
    assert sum(len(rows) for _, _, rows in found) == 60 and len({b for b, _, _ in found}) > 2
    assert [i for _, _, rows in found for i in rows.column("doc_id").to_pylist()] == list(range(60))


def test_nothing_to_learn_from(spark, tmp_path):
    held = [(i, f"some text {i}") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    check(spark, held, tmp_path)
    empty = table_of(spark, documents(spark, []), tmp_path, "none")
    assert ppm.ppm_scores(empty, remainder_is("doc_id", 7, 2)).count() == 0


def test_learning_helps():
    strings = [b"the cat sat on the mat", b"the cat ran", b"qzx"]
    codes = ppm.byte_strings(strings[:2])[0]
    import numpy as np

    keys, counts = np.unique(codes, return_counts=True)
    trie = ppm.levels(keys, counts.astype(float), [], range(ppm.ORDER + 1))
    known = ppm.log_probabilities(ppm.byte_strings([b"the cat sat"])[0], trie).mean()
    assert known > ppm.log_probabilities(ppm.byte_strings([strings[2]])[0], trie).mean()
