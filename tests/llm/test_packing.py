import random
import zlib
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from logmill.llm import packing
from logmill.llm.common import word_tokenizer_path
from tests.llm.helpers import LONG, ODD, documents, table_of

TEXTS = [
    "á b́", " ́x", "Σας ΟΔΟΣ", "<|endoftext|>a <|startoftext|>", "don't WE'LL it's", "x\x1cy\x85z\xa0q r", "İstanbul ǅ ﬃ",
    "가각 ᄀ ᅡ", "\x0b\x0c a\x00b", "😀😀 漢字", "a\nb\tc\r\nd", "w" * 5000, LONG,
]


@cache
def plain():
    return Tokenizer.from_file(word_tokenizer_path())


def plain_ids(text):
    return [*plain().encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_against_whole_texts():
    with open(word_tokenizer_path(), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    rng = random.Random(7)
    alphabet = "ab'tsAÉ .<|endoftext|>\n\t\u0301Éß漢1\x85,!? "
    texts = [*TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(600))]
    texts += ["İ क़ ok. ΣΑΣ, ΟΔΟΣ. The THE the. x.! a.\u0301 ½. ²a, ǅ", "İ"] * 2
    for found in (encoder.encode(texts), encoder.encode(texts), [encoder.encode([t])[0] for t in texts]):
        assert [[*np.frombuffer(f, "<u4").tolist(), 1] for f in found] == [plain_ids(t) for t in texts]


def fullest_by_hand(lengths, most):
    """The largest sum up to ``most`` of lengths among which is the largest."""
    sums = {max(lengths)}
    rest = sorted(lengths)[:-1]
    for length in rest:
        sums |= {s + length for s in sums if s + length <= most}
    return max(sums)


def test_combinations_against_all_sums():
    rng = random.Random(11)
    for _ in range(300):
        most = rng.randint(5, 60)
        lengths = [rng.randint(1, most) for _ in range(rng.randint(1, 14))]
        counts = {n: lengths.count(n) for n in lengths}
        chosen = packing.fullest(counts, most)
        assert max(counts) in chosen and all(0 < n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == fullest_by_hand(lengths, most)


def fewest(lengths, most):
    """The least number of sequences, by trying every place of every piece."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + lengths[i] <= most}:
            at = bins.index(room)
            put(i + 1, [*bins[:at], room + lengths[i], *bins[at + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best[0]


def test_plans_against_the_fewest():
    rng = random.Random(13)
    more = 0
    for _ in range(60):
        most = rng.randint(6, 20)
        lengths = [rng.randint(1, most) for _ in range(rng.randint(1, 9))]
        plan = packing.plan_sequences({n: lengths.count(n) for n in lengths}, most)
        taken = sorted(k for times, chosen in plan for k, n in chosen.items() for _ in range(n * times))
        assert taken == sorted(lengths)
        more += sum(times for times, _ in plan) - fewest(lengths, most)
    assert more <= 2


def test_plan_is_short_for_any_number_of_pieces():
    rng = random.Random(17)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 600)}
    plan = packing.plan_sequences(counts, 600)
    assert len(plan) < 2000
    assert sum(times * sum(k * n for k, n in chosen.items()) for times, chosen in plan) == sum(k * n for k, n in counts.items())


def check_packed(rows, texts, most):
    """Every piece once, sequences without gaps and within bounds; returns how many."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sorted(map(str, pieces)) == sorted(map(str, {i for i, _ in texts}))
    for doc_id, own in pieces.items():
        expected = []
        for text in (t for i, t in texts if i == doc_id):
            ids = plain_ids(text)
            for k, start in enumerate(range(0, len(ids), most)):
                some = ids[start : start + most]
                expected.append((k, start, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == sorted(expected)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= most
    return len(sequences)


@pytest.mark.parametrize("most", [7, 4096])
def test_pieces_and_sequences(spark, tmp_path, most):
    rng = random.Random(most)
    texts = [*ODD, *((100 + i, " ".join("abc" for _ in range(rng.randint(0, 30)))) for i in range(300)), (500, "w" * 3000)]
    texts += [(600 + i, "the same words") for i in range(200)]
    docs = documents(spark, texts, 5).selectExpr("*", "1 AS length", "2 AS nth", "3 AS part", "'x' AS ids")
    found = packing.pack(docs, word_tokenizer_path(), most).collect()
    used = check_packed(found, texts, most)
    total = sum(len(plain_ids(t)) for _, t in texts)
    assert used <= -(-total // most) * 1.02 + 1
    none = table_of(spark, documents(spark, []), tmp_path, "none")
    assert packing.pack(none, word_tokenizer_path(), most).count() == 0


def test_ids_come_along(spark):
    rows = packing.pack(documents(spark, [(1, "one two"), (2, None)]), word_tokenizer_path(), ids=True).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows} == {1: plain_ids("one two"), 2: [1]}
    assert len({r["sequence_id"] for r in rows}) == 1


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    used = check_packed(packing.pack(docs, word_tokenizer_path()).collect(), texts, 4096)
    assert used <= -(-sum(len(plain_ids(t)) for _, t in texts) // 4096) + 1
