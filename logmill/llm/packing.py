"""Packing of token sequences by minimum bin slack.

A document is its token ids and an end id; only documents longer than ``most`` tokens are
cut, into pieces of ``most``. Pieces go into sequences of at most ``most`` tokens.

**Minimum bin slack.** Only lengths matter, and there are at most ``most`` of them, so the
plan is made on their counts, whatever the number of documents. For a sequence the largest
length left is taken, and a subset-sum table in bits (one bit a sum; a length that is there
n times enters by powers of two) over the lengths left, largest first, finds the fullest
combination beside it; the table ends as soon as the sequence is full. The same
combination stays the fullest one until one of its lengths runs out, so it is taken as
often as it can be: a plan has one entry for about each length, not for each sequence.

**Scale.** Pieces of one length are interchangeable. A task numbers its pieces by length
as they come; counts by (task, length) give each task's first number, so no length, however
common, meets in one task. A piece's number and length then say its sequence and its
place: entries of the plan cover ranges of numbers of a length. Only the counts by length
and the plan (some entries a length) pass through the driver.

Tokens: a text is split at blanks, line ends and tabs, which no token crosses, and each
chunk is encoded once a worker (a bounded cache, long chunks outside it) by the tokenizer.

Edge cases: null text is empty and still has its end id; null or repeated ids are rows of
their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from logmill.llm.packs import tidy
from logmill.session import materialize

MOST = 4096
END = 1
CACHED = 1 << 19  # chunks that a worker remembers
LONG = 64  # characters of a chunk that is not remembered
TEXTS = 256  # whose new chunks are encoded together
MARKS = ".,;:!?"
LATIN = re.compile("[a-zß-öø-ÿ]+")
PIECES = "piece int, start long, length long, ids_crc32 long"


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_signs() -> dict[int, str]:
    """The sign that the tokenizer's byte level writes for each byte, from what it writes for letters."""
    level, signs = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for code in (*range(0x21, 0x800), *range(0x800, 0x110000, 0x1000)):
        if not 0xD800 <= code < 0xE000:
            signs.update(zip(chr(code).encode(), level.pre_tokenize_str(chr(code))[0][0], strict=True))
    return signs


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, with the chunks seen so far.

    A chunk of Latin letters is one word to the tokenizer, in small letters, and a closing
    mark after it another: the word goes to the tokenizer's model as it is. All other
    chunks go through the whole tokenizer.
    """

    def __init__(self, data: str) -> None:
        self.tokenizer = Tokenizer.from_str(data)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, chunk: str) -> bytes:
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _learn(self, chunks: set[str]) -> None:
        known, tokenize, is_word = self.known, self.model.tokenize, LATIN.fullmatch
        marks = {mark: self._whole(mark) for mark in MARKS}
        for chunk in chunks:
            closed = chunk[-1] in marks
            word = (chunk[:-1] if closed else chunk).lower()
            if not is_word(word):
                known[chunk] = self._whole(chunk)
                continue
            ids = known.get(word)
            if ids is None:
                signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
                ids = known[word] = packed([t.id for t in tokenize(signs)])
            known[chunk] = ids + marks[chunk[-1]] if closed else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            for blank in "\n\t\r":
                text = text.replace(blank, " ")
            split.append(text.split(" "))
        if len(self.known) > CACHED:
            self.known = {"": b""}
        new = set().union(*split).difference(self.known)
        self._learn(new)
        found = [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]
        for chunk in new:
            if len(chunk) > LONG:
                del self.known[chunk]
        return found


@lru_cache(maxsize=1)
def encoder_of(data: str) -> Encoder:
    """One for a worker, whose tasks share its memory of chunks."""
    return Encoder(data)


def _pieces(data: str, most: int, end: int, ids: bool):
    """Pieces of documents, numbered by length within the task."""
    closing = packed([end])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = encoder_of(data), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            own, rows = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            encoded = (e for k in range(0, len(texts), TEXTS) for e in encoder.encode(texts[k : k + TEXTS]))
            for place, found in enumerate(encoded):
                found += closing
                for piece, start in enumerate(range(0, len(found) // 4, most)):
                    some = found[4 * start : 4 * (start + most)]
                    length = len(some) // 4
                    own.append(place)
                    rows.append((piece, start, length, zlib.crc32(some), part, seen[length], some if ids else None))
                    seen[length] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            keep = 7 if ids else 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(own, pa.int64())), *columns[:keep]], ["doc_id", *names[:keep]]
            )

    return make


def fullest(counts: dict[int, int], most: int) -> dict[int, int]:
    """Lengths, with how often each, of the fullest combination that holds the largest."""
    first = max(counts)
    room, bits, steps = most - first, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        times = 1
        while left and not bits >> room & 1:
            times = min(times, left)
            steps.append((length, times, bits))
            bits |= bits << (length * times) & mask
            left -= times
            times *= 2
    total, chosen = bits.bit_length() - 1, Counter({first: 1})
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            chosen[length] += times
    return dict(chosen)


def plan_sequences(counts: dict[int, int], most: int = MOST) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often}) of the sequences that hold pieces of these lengths."""
    left, plan = {length: n for length, n in counts.items() if n}, []
    while left:
        chosen = fullest(left, most)
        times = min(left[length] // n for length, n in chosen.items())
        plan.append((times, chosen))
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


class Places:
    """Sequence and offset of the nth piece of a length, by the entries of a plan."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]) -> None:
        used, rows, base = Counter(), [], 0
        for times, chosen in plan:
            offset = 0
            for length, n in sorted(chosen.items(), reverse=True):
                rows.append((length, used[length], n, base, offset))
                used[length] += n * times
                offset += length * n
            base += times
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.searchsorted(self.rows[:, 0], length)
        ends = np.searchsorted(self.rows[:, 0], length, "right")
        while (wide := ends - begins > 1).any():  # the last entry that begins at or before nth
            middle = (begins + ends) // 2
            right = wide & (self.rows[np.minimum(middle, len(self.rows) - 1), 1] <= nth)
            begins, ends = np.where(right, middle, begins), np.where(wide & ~right, middle, ends)
        _, first, each, base, offset = self.rows[begins].T
        turn = nth - first
        return base + turn // each, offset + turn % each * length


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece, and
    its ids (little-endian unsigned 32-bit integers) if asked for. ``tokenizer`` is the path of
    its file; ``docs`` has doc_id and text."""
    with open(tokenizer, encoding="utf-8") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids binary" if ids else ""
    found = docs.select("doc_id", "text").mapInArrow(
        tidy(lambda batches: _pieces(data.value, most, end, ids)(batches)), f"doc_id {kind}, {PIECES}, part int, nth long{more}"
    )
    found = materialize(found, "pieces")
    counted = materialize(found.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_sequences(totals, most)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            sequence, offset = places.value.of(columns["length"].to_numpy(), columns.pop("nth").to_numpy())
            columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    numbered = found.join(firsts, ["part", "length"]).withColumn("nth", F.col("first") + F.col("nth")).select(*names, "nth")
    return numbered.mapInArrow(place, f"doc_id {kind}, {PIECES}{more}, sequence_id long, offset long")
