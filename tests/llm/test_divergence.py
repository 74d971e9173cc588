import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logmill.llm import divergence
from tests.llm.helpers import LONG, table_of

DOCS = "doc_id long, text string, lang string, source string"


def plain_rows(rows, most_terms):
    """The contract over (text, lang, source), with whole numbers of any size."""
    lower = {c: c + 32 for c in range(65, 91)}
    groups, seen = {}, {}
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
        seen.setdefault(lang or "", Counter()).update(set(words))
    out = set()
    for (lang, source), counts in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        peers = {s: c for (g, s), c in groups.items() if g == lang}
        total = sum(peers.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))

        def rank(part, values, lang=lang, source=source):
            values = sorted(values, key=lambda v: (-v[1], v[0].encode()))
            return [(lang, source, part, item, value, k) for k, (item, value) in enumerate(values, 1)]

        def excess(p, q):
            return (p - q) ** 2 // q

        out |= set(rank("pair", [(s, sum(excess(share(counts, t), share(c, t)) for t in kept)) for s, c in peers.items() if s != source]))
        terms = [(t, share(counts, t), share(total, t)) for t in kept if counts[t]]
        out |= set(rank("term", [(t, excess(p, q)) for t, p, q in terms if p > q])[:most_terms])
    return out


def found_rows(docs, most_terms):
    rows = divergence.source_divergence(docs, most_terms).collect()
    out = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("most_terms, peers", [(200, 1024), (3, 2)])
def test_against_plain_numbers(spark, monkeypatch, most_terms, peers):
    monkeypatch.setattr(divergence, "PEERS", peers)
    rng = np.random.default_rng(5)
    words = ["été", "The", "the", "漢字", "x", "straße", "a'b", "İi", "no1", "z" * 300, "hot"]
    rows = [
        (" ".join(rng.choice(words, rng.integers(0, 30))), ["en", "fr", None][i % 3], ["a", "b", None, "hot", "漢"][min(4, i % 11)])
        for i in range(160)
    ]
    rows += [(None, "en", "none"), ("", "xx", "one"), ("alone here", "xx", "two"), (LONG, "en", "a"), (LONG, "en", "b"), (LONG, "en", "long")]
    rows += [("same same", "yy", "s")] * 4
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).selectExpr("*", "1 AS n", "2 AS total", "'x' AS term")
    assert found_rows(docs.repartition(6), most_terms) == plain_rows(rows, most_terms)


def test_chunks_add_up(monkeypatch):
    """Corrections do not depend on how the index is cut into chunks and batches."""
    rng = np.random.default_rng(9)
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("zero", pa.int64())]))
    zero = {f"s{i}": int(z) for i, z in enumerate(rng.integers(1, 50, 12))}
    lists = [
        [{"source": f"s{i}", "p": int(rng.integers(50, 10**9)), "zero": zero[f"s{i}"]} for i in rng.permutation(12)[: rng.integers(2, 12)]]
        for _ in range(60)
    ]
    langs = [f"l{k % 3}" for k in range(60)]

    def run(postings, size):
        monkeypatch.setattr(divergence, "POSTINGS", postings)
        batch = pa.record_batch([pa.array(langs), pa.array(lists, kind)], ["lang", "sources"])
        total = Counter()
        for out in divergence._scatter(iter([batch.slice(k, size) for k in range(0, 60, size)])):
            for r in out.to_pylist():
                total[r["lang"], r["source"], r["item"]] += r["value"]
        return {k: v for k, v in total.items() if v}

    expected = Counter()
    for lang, posts in zip(langs, lists, strict=True):
        for a in posts:
            for b in posts:
                if a["source"] != b["source"]:
                    (p, z), (q, y) = (a["p"], a["zero"]), (b["p"], b["zero"])
                    f = lambda x, w: (x - w) ** 2 // w
                    expected[lang, a["source"], b["source"]] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
    expected = {k: v for k, v in expected.items() if v}
    assert run(1 << 18, 60) == run(7, 60) == run(40, 11) == expected


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Längste Wörter, " * 40 + "x" * 50
    found = [w.decode() for words in divergence.words_of(text.encode()) for w in words]
    assert found == re.findall("[a-zäö]+", text.lower())


def test_counts_beyond_long(spark):
    frame = spark.createDataFrame([(10**12, 10**13, 10**7)], "n long, own long, kept long")
    assert frame.select(divergence._share("n", "own", "kept").alias("p")).first()["p"] == 1 + 10**9 * (10**12 + 1) // (10**13 + 10**7)


def test_empty_table(spark, tmp_path):
    assert divergence.source_divergence(table_of(spark, spark.createDataFrame([], DOCS), tmp_path)).count() == 0
