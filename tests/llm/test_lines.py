import random

from pyspark.sql import functions as F

from logmill.llm import lines
from tests.llm.helpers import ODD, documents

WORDS = [f"w{i}" for i in range(40)]


def plain_result(rows, least):
    """Deleted lines by looking at every run of lines, documents in order."""
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    spans = {}
    for place, (_, _, text) in enumerate(order):
        body = text.split("\n")
        for a in range(len(body)):
            for b in range(a, len(body)):
                if sum(len(x.split()) for x in body[a : b + 1]) >= least:
                    spans.setdefault(tuple(body[a : b + 1]), []).append((place, a, b))
    gone = {}
    for found in spans.values():
        for place, a, b in sorted(found)[1:]:
            gone.setdefault(place, set()).update(range(a, b + 1))
    return {
        order[p]: "\n".join(x for k, x in enumerate(order[p][2].split("\n")) if k not in gone.get(p, ()))
        for p in range(len(order))
    }


def test_against_every_run_of_lines(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choices(WORDS, k=rng.randint(0, 7))) for _ in range(30)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 6))] for _ in range(8)]
    rows = []
    for i in range(60):
        body = []
        for _ in range(rng.randint(1, 4)):
            body += rng.choice(passages) if rng.random() < 0.6 else [" ".join(rng.choices(WORDS, k=5)) for _ in range(2)]
        rows.append((i, "\n".join(body)))
    docs = documents(spark, rows)
    # documents in which a passage overlaps itself differ by how the period is cut
    out = {r["doc_id"]: r["text"] for r in lines.delete_repeated_lines(docs, 12).collect()}
    expected = plain_result(rows, 12)
    assert {i: expected[(True, i, t)] for i, t in rows} == out
    assert any(out[i] != t for i, t in rows)


def test_winnowing_guarantee():
    rng = random.Random(2)
    passage = [" ".join(rng.choices(WORDS, k=4)) for _ in range(6)]
    marks = []
    for _ in range(2):
        body = [" ".join(rng.choices(WORDS, k=9)) for _ in range(3)] + passage + [" ".join(rng.choices(WORDS, k=9))]
        marks.append({m for _, _, m, _, _ in lines.windows("\n".join(body), 20)})
    assert marks[0] & marks[1]


def test_long_passages_go_and_short_lines_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    split = "\n".join(" ".join(f"q{i}-{k}" for i in range(20)) for k in range(3))
    rows = [(1, f"intro\n{passage}\nshort line\n{split}"), (2, f"{passage}\nother\nshort line"), (3, f"x\n{split}\ny")]
    out = {r["doc_id"]: r for r in lines.delete_repeated_lines(documents(spark, rows)).collect()}
    assert out[1]["text"] == rows[0][1]
    assert out[2]["text"] == "other\nshort line" and out[2]["deleted_runs"][0]["last"] == 0
    assert out[3]["text"] == "x\ny" and [(r["first"], r["last"]) for r in out[3]["deleted_runs"]] == [(1, 3)]


def test_odd_rows(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 AS first", "2 AS `last`", "'x' AS mark", "5 AS text_hash", "6 AS content")
    out = lines.delete_repeated_lines(docs)
    assert out.columns == [*docs.columns, "deleted_runs"]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(ODD, key=str)
    assert lines.delete_repeated_lines(documents(spark, [])).count() == 0


def test_columns_of_any_name_are_kept(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    more = ["deleted_runs", "__own", "__hash", "__id", "__first", "row", "id", "own", "firsts", "text_hash", "a`b", "c.d"]
    docs = documents(spark, [(1, passage), (2, f"{passage}\nmore"), (3, None)])
    docs = docs.select("*", *[F.lit(f"{k}").alias(name) for k, name in enumerate(more)])
    out = lines.delete_repeated_lines(docs)
    assert out.columns == [*docs.columns, "deleted_runs_"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == passage and rows[2]["text"] == "more" and rows[3]["text"] is None
    assert all([r[name] for name in more] == [str(k) for k in range(len(more))] for r in rows.values())
