import random

import numpy as np
import pytest
import xxhash

from logmill.llm import simhash
from tests.llm.helpers import ODD, documents, table_of


def plain_simhash(text, words=3):
    tokens = [t for t in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    values = np.array(sorted(set(values)), np.uint64)
    linked = np.bitwise_count(values[:, None] ^ values) <= 3
    root = np.arange(len(values))
    while True:
        least = np.where(linked, root, len(values)).min(axis=1)
        if (least == root).all():
            return dict(zip(values.tolist(), values[root].tolist(), strict=True))
        root = least


def test_every_three_positions_leave_one_set():
    from itertools import combinations

    assert len(simhash.PLANES) == 14
    assert all(any(not set(c) & set(p) for p in simhash.PLANES) for c in combinations(range(8), 3))


@pytest.mark.parametrize("crowd", [2, 5, 1024])
def test_links_against_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    values = {rng.getrandbits(64) for _ in range(60)}
    for seed in list(values)[:12]:  # chains and dense groups
        for _ in range(12):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(seed)
    dense = rng.getrandbits(64) & ~0xFFFFFF
    values |= {dense | rng.getrandbits(10) for _ in range(40)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), crowd).collect()
    expected = components(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for e in edges:
        a, b = find(e["a"] % (1 << 64)), find(e["b"] % (1 << 64))
        assert expected[a] == expected[b]
        root[max(a, b)] = min(a, b)
    assert {v: find(v) for v in values} == expected


def test_texts(spark):
    rows = [*ODD, (8, "a b"), (9, "A  b"), (10, "one two three FOUR five " * 700), (11, "x\x0by\x0cz")]
    docs = documents(spark, rows).selectExpr("*", "1L AS fp", "'x' AS fingerprint")
    found = simhash.simhash_components(docs).collect()
    expected = sorted((i or -1, f"{plain_simhash(t):016x}") for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in found) == expected
    root = components([plain_simhash(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            group = root[plain_simhash(t)]
            least[group] = min(least.get(group, i), i)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, least.get(root[plain_simhash(t)])) for i, t in rows}
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_one_of_each_stays(spark, tmp_path):
    """The rows kept are those of brute force: the least id of each component, once."""
    base = [f"w{k}" for k in range(1200)]
    near = [(100 + i, " ".join("other" if k == 7 * i else w for k, w in enumerate(base))) for i in range(30)]
    rows = [*ODD, *near, (8, ODD[0][1])]
    docs = documents(spark, rows).selectExpr("*", "'x' AS row", "'y' AS Row_", "doc_id AS component_id", "1 AS fp", "text AS fingerprint")
    out = simhash.keep_one_of_each(table_of(spark, docs, tmp_path))
    assert out.columns == docs.columns
    of = components([plain_simhash(t) for _, t in rows])
    least = {}
    for i, t in rows:
        key = of[plain_simhash(t)]
        least[key] = min(least.get(key, (True, None)), (i is None, i), key=lambda x: (x[0], x[1] or 0))
    assert sorted(map(str, least.values())) == sorted(str((r["doc_id"] is None, r["doc_id"])) for r in out.collect())
    assert simhash.keep_one_of_each(table_of(spark, documents(spark, []), tmp_path, "none")).count() == 0
