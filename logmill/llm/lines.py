"""Repeated passages by winnowing over line hashes.

A passage is a run of consecutive lines with at least ``least_words`` words. In the
order of documents (id, then hash of the text) and lines, a passage that came before
is deleted where it comes again.

A window is the shortest such run that starts, or that ends, at a line. Any passage is
covered by windows that lie within it: the one that starts at its first line, and for
each later line the one that ends there. Each window selects the least hash of its
lines, the last of equals, as its fingerprint; a passage that repeats has the same
windows and so the same fingerprints each time, which is the guarantee of winnowing.
Fingerprints found at one position only are dropped, the others joined back to their
windows, and windows are then compared by their whole content (128-bit hash). The
first of equal windows stays; the lines of the others go. As the windows around a
fingerprint reach to both sides, what goes is the match extended both ways to all of
its lines. No pairs of positions are made: each position meets only the first one.

Lines end at ``\\n`` and are compared byte by byte, whole: a repeated passage that begins
or ends inside a line is found only as far as its whole lines hold enough words. In text of period shorter than a
passage the first period stays.

Edge cases: null and empty texts have one empty line and stay as they are; a null id
comes first; rows with equal id and text are one document and get the same result; an
empty table gives an empty table. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from logmill.llm.common import column, unused_name
from logmill.llm.packs import tidy
from logmill.session import materialize

LEAST_WORDS = 50
WINDOWS = "doc_id long, text_hash long, first int, last int, mark long, place long, content binary"


def windows(text: str, least_words: int) -> list[tuple[int, int, int, int, bytes]]:
    """(first, last, fingerprint, its line, content) of each window of a text."""
    lines = text.encode().split(b"\n")
    words = [len(line.split()) for line in lines]
    ends = np.cumsum(words)
    if ends[-1] < least_words:
        return []
    begins = ends - words
    n = len(lines)
    forward = np.searchsorted(ends, begins + least_words)
    backward = np.searchsorted(begins, ends - least_words, side="right") - 1
    found = {(i, int(j)) for i, j in enumerate(forward) if j < n}
    found |= {(int(i), j) for j, i in enumerate(backward) if i >= 0}
    hashes = np.array([xxhash.xxh64_intdigest(line) for line in lines], np.uint64)
    out = []
    for first, last in sorted(found):
        part = hashes[first : last + 1]
        least = last - int(part[::-1].argmin())
        content = xxhash.xxh128_digest(b"\n".join(lines[first : last + 1]))
        out.append((first, last, int(hashes[least].view(np.int64)), least, content))
    return out


def _window_rows(least_words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(7)]
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for first, last, mark, line, content in windows(text, least_words):
                    place = xxhash.xxh64_intdigest(f"{doc_id} {text_hash} {line}".encode()) - (1 << 63)
                    for column, value in zip(columns, (doc_id, text_hash, first, last, mark, place, content), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "text_hash", "first", "last", "mark", "place", "content"],
            )

    return make


def repeated_windows(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, first, last) of the windows whose content came before."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = materialize(keyed.mapInArrow(tidy(_window_rows(least_words)), WINDOWS), "line-windows")
    marks = (
        found.groupBy("mark")
        .agg(F.min("place").alias("least"), F.max("place").alias("most"))
        .where("least != most")
        .select("mark")
    )
    met = materialize(found.join(materialize(marks, "line-marks"), "mark", "left_semi").drop("mark", "place"), "line-met")
    place = F.struct("doc_id", "text_hash", "first")
    firsts = materialize(met.groupBy("content").agg(F.min(place).alias("start")), "line-firsts")
    return (
        met.join(firsts, "content")
        .where(~place.eqNullSafe(F.col("start")))
        .select("doc_id", "text_hash", "first", "last")
    )


def drop_lines(text: str, firsts: list[int], lasts: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the lines of the spans, and the spans merged into runs."""
    lines = text.split("\n")
    change = np.zeros(len(lines) + 1, np.int64)
    np.add.at(change, np.array(firsts), 1)
    np.add.at(change, np.array(lasts) + 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    runs = [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return "\n".join(line for line, g in zip(lines, gone, strict=True) if not g), runs


RUNS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))


def delete_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated passages; the columns stay as they are,
    whatever their names, and ``deleted_runs`` (first and last line, from 0) is added, as
    the last one (with ``_`` at its end where that name is taken)."""
    spans = (
        repeated_windows(docs, least_words)
        .distinct()
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    )
    spans = materialize(spans, "line-spans")
    rows = docs.select(
        F.struct(*map(column, docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"),
    )
    same = (F.col("own") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id"))
    names, runs_name = docs.columns, unused_name(docs, "deleted_runs")
    at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = [], []
            columns = batch.column("row").flatten()
            for text, first, last in zip(columns[at].to_pylist(), *(batch.column(c).to_pylist() for c in ("firsts", "lasts")), strict=True):
                text, run = drop_lines(text, first, last) if first else (text, [])
                texts.append(text)
                runs.append([{"first": a, "last": b} for a, b in run])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs, kind)], [*names, runs_name])

    schema = StructType([*docs.schema.fields, StructField(runs_name, RUNS)])
    return rows.join(spans, same, "left").select("row", "firsts", "lasts").mapInArrow(tidy(clean), schema)
