import hashlib
import random

from logmill.llm import fingerprint as fp
from tests.llm.helpers import ODD, documents


def test_spans_and_extensions_against_text():
    rng = random.Random(1)
    a = "".join(rng.choices("ab\0é", k=300))
    b = a[50:120] + "zz" + a[10:90]
    ha, hb = fp.PrefixHash(a), fp.PrefixHash(b)
    for _ in range(300):
        i, j, n = rng.randrange(250), rng.randrange(100), rng.randrange(50)
        assert ha.span_equal(i, hb, j, n) == (a[i : i + n] == b[j : j + n])
        same = next((k for k in range(301) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 0)
        assert ha.extension(i, hb, j) == same


def test_longest_extensions_of_a_table(spark):
    rows = [("hello there", 6, "all there is", 4), ("a", 5, "a", 0), (None, 0, "x", 0), ("x", None, "x", 0), ("xyz", 0, "xyz", 0)]
    pairs = spark.createDataFrame(rows, "text_a string, start_a int, text_b string, start_b int").coalesce(1)
    assert [r["extension"] for r in fp.longest_extensions(pairs).collect()] == [5, 0, 0, 0, 3]


def test_sketch_estimates_shared_spans():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    a = " ".join(rng.choices(words, k=3000))
    near, far = a[: len(a) * 9 // 10], " ".join(rng.choices(words, k=3000))
    sa, sn, sf = (fp.sketch(fp.code_points(t)) for t in (a, near, far))
    assert fp.likeness(sa, sa) == 1 and fp.likeness(sa, sn) > 0.7 > 0.3 > fp.likeness(sa, sf)
    assert fp.likeness(*(fp.sketch(fp.code_points(t)) for t in ("", ""))) == 1
    assert fp.likeness(fp.sketch(fp.code_points("")), fp.sketch(fp.code_points("a"))) == 0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    out = []
    for (i, _), a, b in zip(order, texts, [*texts[1:], texts[0]], strict=True):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        out.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(a)[0], fp.fingerprint(edited)[0]))
    return sorted(out, key=str)


def test_next_text(spark):
    rows = [(i * 7 % 101, f"text {i} " * (i % 13) + "é😀" * (i % 5)) for i in range(1, 100)]
    for per_task in (1, 8, 4000):
        found = fp.compare_with_next(documents(spark, rows), per_task).collect()
        assert sorted((tuple(r)[:5] for r in found), key=str) == expected(rows)
    equal = {}
    for r in found:
        equal.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in equal.values())


def test_odd_rows(spark):
    rows = [r for r in ODD if r[0] is not None]
    docs = documents(spark, rows).selectExpr("*", "1 AS bucket", "2 AS spare", "3 AS at")
    found = fp.compare_with_next(docs, 2).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == expected(rows)
    assert fp.compare_with_next(documents(spark, ODD), 2).count() == len(ODD)
    assert fp.compare_with_next(documents(spark, [(1, "alone")])).collect()[0]["near_next"] == 1
    assert fp.compare_with_next(documents(spark, [])).count() == 0
