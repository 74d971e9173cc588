"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logmill.session import materialize, round_tables

PIECE = 1 << 20  # edges that a task contracts at once


def _to_least_neighbour(edges: DataFrame, keep) -> DataFrame:
    """Link the neighbours ``v`` of each ``u`` to the least of them and ``u``.

    The minimum is a grouped aggregate (copies of ``u`` collapse per task). It is
    written before it goes back, so that both sides of the join have an exchange of
    their own and adaptive execution can split a hot ``u``; no task has to hold all
    neighbours of a node.
    """
    least = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return edges.join(least, "u").where(keep)


def _pairs(df: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(u, v) rows from each given pair of columns, in one pass."""
    each = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends]
    return df.select(F.explode(F.array(*each)).alias("p")).select("p.u", "p.v")


def least_connected(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For each of ``nodes`` places, the least place that links (a, b) connect it with."""
    root = np.arange(nodes)
    while True:
        least, low = np.minimum(root[a], root[b]), root.copy()
        for ends in (a, b, root[a], root[b]):
            np.minimum.at(low, ends, least)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) as stars around the least node of each connected set."""
    names, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = least_connected(places[: len(u)], places[len(u) :], len(names))
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the least node of each connected set."""
    held = list(batches)
    if not held:
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
    a, b = stars(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``, longs; the component is its
    least node. Pieces of about ``PIECE`` edges, dealt by a hash of both ends, are
    contracted to stars; where there is more than one piece, large-star and small-star
    steps alternate until nothing moves. The number of rounds grows with the logarithm
    of the longest path.
    """
    write = round_tables(edges.sparkSession, "components")

    def settle(df: DataFrame):
        """One round's edges, written, with a fingerprint taken on the way."""
        seen = Observation()
        key = F.xxhash64("u", "v")
        out = write(df.observe(seen, F.count("*").alias("n"), F.bit_xor(key).alias("x"), F.max(key).alias("m")))
        return out, seen.get

    pairs, before = settle(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    pieces = -(-before["n"] // PIECE)
    if before["n"]:
        pairs, before = settle(pairs.repartition(pieces, "u", "v").mapInArrow(_contract, "u long, v long").distinct())
    while pieces > 1:
        both = _pairs(pairs, ("u", "v"), ("v", "u"))
        large = (
            _to_least_neighbour(both, F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        small = _to_least_neighbour(large, F.lit(True))
        pairs, after = settle(
            _pairs(small, ("v", "m"), ("u", "m")).where(F.col("u") != F.col("v")).distinct()
        )
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
