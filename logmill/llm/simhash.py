"""Near duplicates by SimHash over word shingles.

A fingerprint is 64 bits; two link when at most three bits differ. Three bits touch
at most three of the eight bytes, so linked fingerprints share at least five bytes
in place: that is the count to reach. An index of single bytes would have only
2,048 lists, each growing with the input, so lists are kept for sets of four
positions: the 14 sets whose positions xor to zero. Any three positions lie in one
of these sets, whose complement is another, hence two linked fingerprints meet in
the list of at least one set of four. In a list the shared bytes of each pair are
tallied, pairs with fewer than five are dropped and the rest verified by their
differing bits.

Only distinct fingerprints enter the index, and a list returns a forest (each
member with the least one it is connected to), never its pairs. Lists with more
than ``crowd`` members are split by one more shared byte; where that still leaves
more, members that agree outside three of the 24 free bits are grouped (at most 8
each) and linked to the least of them. So work stays linear in the members of a
list, and no link is lost at any size.

Edge cases: null text is empty; texts without words have fingerprint zero and link
like any other; a null id takes part, and a component of null ids alone has a null
id; repeated rows are returned as often as they come. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmill.llm.common import column, unused_name
from logmill.llm.packs import tidy
from logmill.operators.components import connected_components
from logmill.session import materialize

BITS = 64
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
CROWD = 1024
SEED = 42
ROWS = 255 * 64  # shingles whose bits are counted at once

#: Sets of four byte positions that xor to zero, as masks over a fingerprint.
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]


def _mask(positions) -> int:
    """The signed long with ones in the bytes at the positions."""
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def bit_counts(shingles: Iterator[bytes]) -> tuple[np.ndarray, int]:
    """How many hashes of the shingles have each bit, highest first, and how many there are."""
    counts, total, held = np.zeros(BITS, np.int64), 0, []

    def add() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8)).reshape(-1, BITS)
        whole = len(bits) // 255 * 255
        if whole:
            counts[:] += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts[:] += bits[whole:].sum(axis=0, dtype=np.uint8)

    for shingle in shingles:
        held.append(xxhash.xxh64_digest(shingle, SEED))
        if len(held) == ROWS:
            add()
            total += ROWS
            held.clear()
    if held:
        add()
        total += len(held)
    return counts, total


def shingles_of(text: str, words: int) -> Iterator[bytes]:
    """Lower-cased (A-Z) shingles of ``words`` words, repeats included; a shorter
    text is one shingle, a text without words none."""
    tokens = text.encode().lower().split()
    if len(tokens) <= words:
        return iter([b" ".join(tokens)] if tokens else [])
    return map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))


def simhash(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    counts, total = bit_counts(shingles_of(text or "", words))
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed long."""

    def hash_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(hash_batch), f"doc_id {kind}, fp long")


def _forest(members: np.ndarray) -> np.ndarray:
    """For each of the sorted members, the place of the least one connected to it."""
    n = len(members)
    differ = members[:, None] ^ members[None, :]
    shared = (differ.view(np.uint8).reshape(n, n, 8) == 0).sum(axis=2)
    linked = (shared >= LEAST_BYTES) & (np.bitwise_count(differ) <= MOST_BITS)
    root = np.arange(n)
    while True:
        least = np.where(linked, root[None, :], n).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the forests of lists, from arrays of their members."""
    for batch in batches:
        lists = batch.column("members")
        values = lists.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        a, b = [], []
        start = 0
        for end in ends:
            members = np.sort(values[start:end])
            start = end
            root = _forest(members)
            moved = root != np.arange(len(root))
            a.append(members[moved])
            b.append(members[root[moved]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"]
        )


def _lists(postings: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Edges within the lists of at most ``crowd`` members, and the rows of the others."""
    sized = postings.withColumn("n", F.count("*").over(Window.partitionBy("set", "key"))).where("n > 1")
    few = sized.where(F.col("n") <= crowd).groupBy("set", "key").agg(F.collect_list("fp").alias("members"))
    return few.select("members").mapInArrow(tidy(_verify), "a long, b long"), sized.where(F.col("n") > crowd)


def fingerprint_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): edges whose components are those of all links between the distinct ``fp``."""
    postings = prints.select("fp", F.posexplode(F.array(*[F.lit(_mask(p)) for p in PLANES])).alias("set", "mask"))
    postings = postings.select("set", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    edges, crowded = _lists(postings, crowd)

    rest = F.array(*[F.array(*[F.lit(q) for q in range(8) if q not in p]) for p in PLANES])
    fifth = crowded.select("fp", "set", "key", F.posexplode(rest[F.col("set")]).alias("nth", "byte"))
    split = fifth.select(
        (F.col("set") * 4 + F.col("nth")).alias("set"),
        F.struct("key", F.expr("shiftright(fp, byte * 8) & 255").alias("fifth")).alias("key"),
        "fp",
    )
    more, dense = _lists(split, crowd)

    # what is left agrees in five bytes; the other three, as one number of 24 bits
    free = [[q for q in range(8) if q not in p and q != b] for p in PLANES for b in range(8) if b not in p]
    places = F.array(*[F.array(*[F.lit(8 * q) for q in row]) for row in free])
    left = dense.withColumn("at", places[F.col("set")]).withColumn(
        "bits",
        F.expr("shiftright(fp, at[0]) & 255 | (shiftright(fp, at[1]) & 255) << 8 | (shiftright(fp, at[2]) & 255) << 16"),
    )
    holes = F.array(*[F.lit(~sum(1 << i for i in c) & 0xFFFFFF) for c in combinations(range(24), MOST_BITS)])
    grouped = left.select("set", "key", "fp", "bits", F.posexplode(holes).alias("hole", "mask")).withColumn(
        "a", F.min("fp").over(Window.partitionBy("set", "key", "hole", F.col("bits").bitwiseAND(F.col("mask"))))
    )
    stars = grouped.where("a != fp").select("a", F.col("fp").alias("b"))
    return edges.unionByName(more).unionByName(stars).distinct()


def simhash_components(docs: DataFrame, words: int = 3, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id reachable
    by links, for each row of ``docs``."""
    prints = materialize(fingerprints(docs, words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = materialize(fingerprint_links(distinct.select("fp"), crowd), "simhash-links")
    nodes = connected_components(edges).withColumnRenamed("node", "fp")
    rooted = distinct.join(nodes, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least"
    )
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(roots, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, words: int = 3, crowd: int = CROWD) -> DataFrame:
    """``docs``, columns unchanged, with one row of each component of linked
    fingerprints: that of the least id, and of repeated ids the first in the table.
    Only if there is no other does a row with a null id stay. ``docs`` must be a table
    (its rows are numbered by their place, in two scans).
    """
    row = unused_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), column(row).alias("row"))
    found = simhash_components(numbered.select(named.alias("doc_id"), "text"), words, crowd)
    gone = materialize(found.where("doc_id != component_id").select(F.col("doc_id.row").alias(row)), "simhash-gone")
    return numbered.join(gone, row, "left_anti").drop(row)
