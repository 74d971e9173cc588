"""Document fingerprints from prefix polynomial hashes.

For a text of code points c the array P[i] = sum of c[k] * B^k for k < i, modulo a
prime, gives the hash of any span in constant time: P[j] - P[i] is B^i times the
span's own hash. Spans are brought to a common power before they are compared. Two
primes are used side by side, so a false match has odds of about 2^-62 a comparison.
``PrefixHash`` answers span equality and finds the longest common extension of two
places by binary search; ``longest_extensions`` does so for a table of places.

A fingerprint has two parts: the hash of the whole text under both primes, and a
sketch of all its spans of ``SPAN`` code points: span hashes are dealt to ``SLOTS``
slots and each slot keeps its least one (texts with fewer spans fill empty slots
from their neighbours). The likeness of two fingerprints is the share of slots that
agree, which estimates the share of spans that the texts have in common; it is 1 for
equal texts.

Edge cases: null is empty; a text shorter than ``SPAN`` is one span; the empty text
is like itself (1) and nothing else (0); repeated rows follow each other. Rows are
ordered by ``doc_id`` (null first), then by the text's hash. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 12
SLOTS = 64
SLOT_HEX = 4
ROWS_PER_TASK = 4_000

_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """B^0 ... B^(n-1) modulo a prime, or for -1 those of the first base's inverse;
    kept and doubled as needed."""
    table = _powers.get(which, np.ones(1, np.uint64))
    modulus = PRIMES[max(which, 0)]
    base, prime = BASES[which] if which >= 0 else pow(BASES[0], -1, modulus), np.uint64(modulus)
    while len(table) < n:
        step = np.uint64(pow(base, len(table), modulus))
        table = np.concatenate([table, table * step % prime])
    _powers[which] = table
    return table[:n]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64)


def prefix(points: np.ndarray, which: int = 0) -> np.ndarray:
    """P[0] ... P[n] modulo a prime. A term is below 2^31, so the sum of up to 2^33
    terms fits in 64 bits and is reduced once."""
    prime = np.uint64(PRIMES[which])
    sums = np.zeros(len(points) + 1, np.uint64)
    # + 1, so that code point zero counts as well
    np.cumsum((points + np.uint64(1)) * powers(which, len(points)) % prime, out=sums[1:])
    return sums % prime


class PrefixHash:
    """Span equality and longest common extensions within and between texts."""

    def __init__(self, text: str | None):
        points = code_points(text)
        self.n = len(points)
        self.sums = [prefix(points, w) for w in range(len(PRIMES))]

    def _raised(self, which: int, start: int, length: int, power: int) -> int:
        prime = PRIMES[which]
        value = (int(self.sums[which][start + length]) - int(self.sums[which][start])) % prime
        return value * pow(BASES[which], power - start, prime) % prime

    def span_equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        """Whether two spans that lie within their texts hold the same code points."""
        power = max(start, other_start)
        return all(
            self._raised(w, start, length, power) == other._raised(w, other_start, length, power)
            for w in range(len(PRIMES))
        )

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common span that starts at both places."""
        low, high = 0, max(0, min(self.n - start, other.n - other_start))
        while low < high:
            middle = (low + high + 1) // 2
            if self.span_equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def longest_extensions(pairs: DataFrame) -> DataFrame:
    """Adds ``extension`` to rows of (text_a, start_a, text_b, start_b): how many code
    points agree from the two places on. A place outside its text, or null, gives 0."""

    @F.pandas_udf("long")
    def extend(text_a: pd.Series, start_a: pd.Series, text_b: pd.Series, start_b: pd.Series) -> pd.Series:
        found = []
        for a, i, b, j in zip(text_a, start_a, text_b, start_b, strict=True):
            inside = not pd.isna(i) and not pd.isna(j) and i >= 0 and j >= 0
            found.append(PrefixHash(a).extension(int(i), PrefixHash(b), int(j)) if inside else 0)
        return pd.Series(found, dtype="int64")

    return pairs.withColumn("extension", extend("text_a", "start_a", "text_b", "start_b"))


def sketch(points: np.ndarray) -> np.ndarray:
    """The least mixed span hash of each slot, 16 bits each; nothing for no points."""
    if len(points) == 0:
        return np.zeros(0, np.uint16)
    width = min(SPAN, len(points))
    prime = np.uint64(PRIMES[0])
    sums = prefix(points)
    spans = len(points) - width + 1
    value = (sums[width:] + prime - sums[:spans]) * powers(-1, spans) % prime
    mixed = np.sort((value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32))
    bits = 32 - (SLOTS.bit_length() - 1)
    first = np.searchsorted(mixed, np.arange(SLOTS, dtype=np.uint32) << np.uint32(bits))
    slot = mixed >> np.uint32(bits)
    filled = np.zeros(SLOTS, bool)
    filled[slot[first[first < len(mixed)]]] = True
    least = np.zeros(SLOTS, np.uint32)
    least[filled] = mixed[first[filled]] & np.uint32((1 << bits) - 1)
    # an empty slot takes the next filled one's, and how far away that is
    place = np.nonzero(filled)[0]
    after = place[np.searchsorted(place, np.arange(SLOTS)) % len(place)]
    away = ((after - np.arange(SLOTS)) % SLOTS).astype(np.uint32)
    return ((least[after] * np.uint32(2654435761) + away * np.uint32(0x9E3B)) >> np.uint32(16)).astype(np.uint16)


def fingerprint(text: str | None) -> tuple[str, np.ndarray]:
    """The fingerprint as text, and its sketch."""
    points = code_points(text)
    slots = sketch(points)
    whole = "".join(f"{int(prefix(points, w)[-1]):08x}" for w in range(len(PRIMES)))
    return f"{len(points):x}-{whole}-{slots.astype('>u2').tobytes().hex()}", slots


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots that agree: 1 for two empty texts, 0 for one."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as much of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows that come in order, bucket by bucket, each followed by the next."""
    held = None
    for batch in batches:
        rows = []
        for bucket, spare, doc_id, text in zip(
            *(batch.column(c).to_pylist() for c in ("bucket", "spare", "doc_id", "text")), strict=True
        ):
            printed, slots = fingerprint(text)
            if held is not None and held[0] == bucket:
                _, was, before, before_printed, before_slots = held
                edited = edited_text(before, text)
                edited_printed, edited_slots = fingerprint(edited)
                rows.append(
                    (
                        was,
                        len(before),
                        hashlib.sha256(edited.encode()).hexdigest(),
                        before_printed,
                        edited_printed,
                        likeness(before_slots, edited_slots),
                        likeness(before_slots, slots),
                    )
                )
            held = None if spare else (bucket, doc_id, text, printed, slots)
            if spare:
                held = (None, None, "", "", slots)  # the bucket is over
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, RESULT_TYPES, strict=True)], RESULT_NAMES
        )


RESULT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
NULL_ID = -(1 << 63)


def _bounds(docs: DataFrame, rows_per_task: int) -> np.ndarray:
    """Ids that cut the input into buckets of about ``rows_per_task`` rows: every
    fourth of the ids that a hash picks at four times that rate."""
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows_per_task // 4))) == 0)
    ids = picked.select("doc_id").distinct().where(F.col("doc_id").isNotNull()).toPandas()["doc_id"].to_numpy(np.int64)
    return np.sort(ids)[3::4]


def compare_with_next(docs: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likeness.

    Rows are dealt to buckets by id; the first row of a bucket also goes to the end
    of the bucket before (of the first to the last), so texts are shuffled once and
    no order over all rows passes through one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = spark.sparkContext.broadcast(_bounds(docs, rows_per_task))

    @F.pandas_udf("int")
    def bucket_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, at.to_numpy(np.int64), side="right").astype(np.int32))

    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("at")
    firsts = docs.select(at).groupBy(bucket_of("at").alias("bucket")).agg(F.min("at").alias("at")).toPandas()
    firsts = firsts.sort_values("bucket")
    heads = spark.sparkContext.broadcast(
        (firsts["at"].to_numpy(np.int64), np.roll(firsts["bucket"].to_numpy(np.int32), 1))
    )

    @F.pandas_udf("array<int>")
    def targets(at: pd.Series) -> pd.Series:
        ids = at.to_numpy(np.int64)
        own = np.searchsorted(bounds.value, ids, side="right")
        head, before = heads.value
        place = np.searchsorted(head, ids)
        first = (place < len(head)) & (head[np.minimum(place, len(head) - 1)] == ids)
        return pd.Series([[o, before[p]] if f else [o] for o, p, f in zip(own, place, first, strict=True)])

    dealt = rows.select("*", F.posexplode(targets(F.coalesce("doc_id", F.lit(NULL_ID)))).alias("spare", "bucket"))
    ordered = dealt.withColumn("tie", F.xxhash64("text")).repartition(max(1, len(firsts)), "bucket").sortWithinPartitions(
        "bucket", "spare", F.col("doc_id").asc_nulls_first(), "tie"
    )
    return ordered.select("bucket", "spare", "doc_id", "text").mapInArrow(_compare, RESULT)
