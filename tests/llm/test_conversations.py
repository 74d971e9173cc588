import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from logmill.llm import conversations
from tests.llm.helpers import table_of

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


@lru_cache(maxsize=None)
def every_edit(rows):
    """(cost, audit, roles) of all edits of (role initial, must go, truncated) rows, with few inserts."""

    def walk(i, inserts):
        if i == len(rows):
            yield 0, "", ""
        else:
            initial, gone, cut = rows[i]
            for cost, audit, roles in walk(i + 1, inserts):
                yield cost + 4, "D" + audit, roles
                if not gone:
                    yield cost + 3 * cut, "K" + audit, initial + roles
                    for new in "ua":
                        yield cost + 3 + 3 * cut, "R" + audit, new + roles
        if inserts:
            for cost, audit, roles in walk(i, inserts - 1):
                for new in "ua":
                    yield cost + 3, "I" + audit, new + roles

    return min((cost, audit) for cost, audit, roles in walk(0, 3) if LEGAL.fullmatch(roles))


def blocks_say(rows):
    of = conversations.tables()
    symbols = np.array([0 if gone else conversations.symbol_of(r, cut) for r, gone, cut in rows], np.uint8)
    vectors, cost = of.between(symbols, 0)
    edits, state = of.edits(symbols, vectors, 0)
    return cost, "".join(edits) + conversations.FINISH_EDITS[state]


def test_against_all_edits():
    rng = random.Random(3)
    kinds = [(r, False, cut) for r in "suax" for cut in (False, True)] + [("u", True, False)]
    for n in range(6):
        for _ in range(40):
            rows = tuple(rng.choice(kinds) for _ in range(n))
            assert blocks_say(rows) == every_edit(rows), rows


def plain_repair(rows):
    """The least (cost, audit, lines) over states, row by row, for long conversations."""
    added, names = conversations.ADDED, {2: "user", 3: "assistant"}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def put(into, state, way):
        into[state] = min(into.get(state, way), way)

    def insert(ways):
        out = dict(ways)
        for _ in range(2):
            for s, (c, a, t) in list(out.items()):
                put(out, added[s], (c + 3, a + "I", (*t, names[added[s]] + ":")))
        return out

    for role, text, gone, cut in rows:
        now = {}
        for s, (c, a, t) in insert(best).items():
            put(now, s, (c + 4, a + "D", t))
            if not gone:
                if (s, role[:1]) in keep:
                    put(now, keep[s, role[:1]], (c + 3 * cut, a + "K", (*t, f"{role}:{text}")))
                put(now, added[s], (c + 3 + 3 * cut, a + "R", (*t, f"{names[added[s]]}:{text}")))
        best = now
    return min(way for s, way in insert(best).items() if s in (0, 3))


def plain_report(table):
    """The contract, one conversation after the other."""
    out = {}
    space = " \t\n\x0b\x0c\r"
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind:
                role = "user" if kind == 4 else role
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                rows += [((turn is not None, turn or 0), role, text)] * (2 if kind == 3 else 1)
        rows.sort()
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            bare = text.strip(space)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for (some, t), _, _ in rows if some}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = plain_repair(judged)
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts, "illegal": illegal,
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


def odd_table():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "so", " \t", "", None, "ends here. \n", "İ?", "x\x1c", "Well?", "." * 3, "go on,"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "speaker"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice('.!? ')}")
            for c in range(40) for t in rng.sample(range(30), rng.randint(1, 14))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"say {t}.") for t in range(700)]
    rows += [(None, t, rng.choice(roles), "some text.") for t in (None, None, 1, 2, 2, 3, 9)]
    rows += [(200, None, None, None), (201, 3, "user", "word " * 50_000 + "."), (202, 1, "user", "a."), (202, 1, "user", "b.")]
    rows += [(203, 5, "assistant", "the same row.")] * 900  # equal rows
    rows += [(204, -1, "system", "x."), (204, 2**40, "user", "y.")]
    return rows


@pytest.mark.parametrize("rows, parts", [(512, 4), (7, 13)])
def test_against_plain_rows(spark, rows, parts):
    data = odd_table()
    table = spark.createDataFrame(data, ROWS).selectExpr("*", "1 AS part", "2 AS n_", "'x' AS digest").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = {r["conv_id"]: r.asDict() for r in conversations.damage_and_repair(table, rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = plain_report(data)
    assert set(found) == set(expected)
    for conv, row in expected.items():
        assert found[conv] == row, conv


def test_repaired_text_and_empty_table(spark, tmp_path):
    data = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (2, 0, "assistant", "Well.")]
    pieces = conversations.repair(spark.createDataFrame(data, ROWS), rows=2).orderBy("conv_id", "part", "seg").collect()
    text = {c: "\n".join(p["repaired"] for p in pieces if p["conv_id"] == c and p["repaired"]) for c in (1, 2)}
    assert text[1] == "system:Be kind.\nuser:Hi.\nassistant:Hello?"
    assert text[2] == "user:\nassistant:Well." and "".join(p["audit"] for p in pieces if p["conv_id"] == 2) == "IK"
    none = table_of(spark, spark.createDataFrame([], ROWS), tmp_path)
    assert conversations.damage_and_repair(none).count() == 0
