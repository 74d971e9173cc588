"""How far sources of one language are from each other and from the language.

A group (language and source), or a language, gives each kept term the share
``p = 1 + floor(10^9 (count + 1) / (N + V))``, of V terms and N counts. What p exceeds q
by is ``f(p, q) = floor((p - q)^2 / q)``; a pair of groups has the sum of f over all kept
terms of the language. All numbers are whole, so results are exact.

**Row accumulation.** Sums go over all terms, but most counts are zero, so each pair
starts from what zeros give: the terms of one group against the zero share of the other,
from the histogram of its counts (a source with N tokens has at most sqrt(2 N) different
counts). Terms that both groups have are then corrected. For that a term-major index
(term, its sources with their shares) is read in chunks of whole terms: each group
scatters its terms through the index into a dense accumulator with a place for each peer
of the chunk, and only the accumulator leaves the task. Pairs of postings are never
rows; sums of the chunks are added up by a grouped sum.

**Scale.** Words are counted per task before the first shuffle, so a common word or a
large source costs a row a task. A term's list has one entry a source. Shares join the
exploded index by (language, source), which adaptive execution can split. Peers of a
language come in blocks, so no task holds more than a block and one histogram. The
result holds all pairs of sources of a language, as asked for.

Edge cases: null text, language and source are empty texts. A language without kept terms
has divergences of 0. Repeated rows are documents of their own. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmill.llm.packs import tidy
from logmill.session import materialize

LEAST_DOCS = 3
SCALE = 1_000_000_000
MOST_TERMS = 200
HELD = 1 << 18  # words that a task holds before it gives them on
PIECE = 1 << 20  # bytes of a text that are split at once
POSTINGS = 1 << 18  # of a chunk of the index
PEERS = 1024  # of a block
CELLS = 1 << 22  # of a table of histogram against peers

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 0x20 for b in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words (letters A-Z, lower-cased, and all beyond ASCII), by pieces of a long text."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):  # a piece ends before a byte that is no part of a word
            while end < len(text) and _FOLD[text[end]] != 0x20:
                end += 1
        yield text[start:end].translate(_FOLD).split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) counted over the rows of a task."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in groups.items():
            for start in range(0, len(counts), 1 << 14):
                terms = list(counts)[start : start + (1 << 14)]
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.binary()), pa.array([source] * size, pa.binary()), pa.array(terms, pa.binary()),
                     pa.array([counts[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*[c.cast(pa.binary()).to_pylist() for c in batch.columns], strict=True):
            counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in words_of(text):
                counts.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(c) for c, _ in groups.values()) >= HELD:
            yield from give()
    yield from give()


def term_index(docs: DataFrame) -> DataFrame:
    """(lang, term, total, sources of struct<source, n>) of the terms in enough documents."""
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = plain.mapInArrow(tidy(_count), "lang binary, source binary, term binary, n long, docs long")
    names = ["lang", "source", "term"]
    counts = found.groupBy(names).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.select(*[F.col(c).cast("string").alias(c) for c in names], "n", "docs")
    return (
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
        .where(F.col("docs") >= LEAST_DOCS)
        .drop("docs")
    )


def _share(count: str, total: str, kept: str):
    """The share of a count, as an exact whole number."""
    above = f"CAST({SCALE} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(20,0)) + 1)"
    return F.expr(f"1 + ({above}) div (CAST({total} AS DECIMAL(20,0)) + CAST({kept} AS DECIMAL(20,0)))")


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of groups, from chunks of the term-major index."""

    def chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("sources").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        posts = lists.flatten()
        share, zero = (posts.field(c).to_numpy() for c in ("p", "zero"))
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        sources = posts.field("source").dictionary_encode()
        lang_of = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
        code = lang_of * len(sources.dictionary) + sources.indices.to_numpy()
        codes, peer = np.unique(code, return_inverse=True)
        names = [sources.dictionary[int(c) % len(sources.dictionary)].as_py() for c in codes]
        tongue = [langs.dictionary[int(c) // len(sources.dictionary)].as_py() for c in codes]
        begins = np.cumsum(sizes) - sizes
        term = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(peer, kind="stable")
        cuts = np.searchsorted(peer[order], np.arange(len(codes) + 1))
        for group in range(len(codes)):
            own = order[cuts[group] : cuts[group + 1]]
            size, first = sizes[term[own]], begins[term[own]]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)  # the lists of its terms, end to end
            p, z = np.repeat(share[own], size), zero[own[0]]
            q, y = share[at], zero[at]
            change = excess(p, q) - excess(p, y) - excess(z, q) + excess(z, y)
            into = np.zeros(len(codes), np.int64)
            np.add.at(into, peer[at], change)
            into[group] = 0
            touched = np.flatnonzero(into)
            if len(touched):
                n = len(touched)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tongue[group]] * n), pa.array([names[group]] * n), pa.array([names[i] for i in touched]), pa.array(into[touched])],
                    ["lang", "source", "item", "value"],
                )

    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column("sources").value_lengths().to_numpy())
        start = 0
        while start < batch.num_rows:  # whole terms, until the chunk is full
            low = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, low + POSTINGS - n, "right")))
            held.append(batch.slice(start, stop - start))
            n += int(ends[stop - 1]) - low
            start = stop
            if n >= POSTINGS or start < batch.num_rows:
                yield from chunk(held)
                held, n = [], 0
    if held:
        yield from chunk(held)


def _baseline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What zeros give: each group's histogram against a block of peers, both ways."""
    for batch in batches:
        for row in batch.to_pylist():
            z, peers = row["zero"], row["peers"]
            p = np.array([c["p"] for c in row["counts"]], np.int64)
            n = np.array([c["terms"] for c in row["counts"]], np.int64)
            y = np.array([c["zero"] for c in peers], np.int64)
            to, back = (row["kept"] - n.sum()) * excess(z, y), np.zeros(len(y), np.int64)
            step = max(1, CELLS // max(1, len(y)))
            for start in range(0, len(p), step):
                some, times = p[start : start + step, None], n[start : start + step, None]
                to += (times * excess(some, y)).sum(axis=0)
                back += (times * (excess(y, some) - excess(y, z))).sum(axis=0)
            names = [c["source"] for c in peers]
            keep = np.array([c != row["source"] for c in names], bool)
            others, mine = [c for c in names if c != row["source"]], [row["source"]] * int(keep.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * (2 * len(mine)), pa.string()), pa.array(mine + others, pa.string()),
                 pa.array(others + mine, pa.string()), pa.array(np.concatenate([to[keep], back[keep]]))],
                ["lang", "source", "item", "value"],
            )


def source_divergence(docs: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank. Part ``pair``: each other source of the
    language. Part ``term``: the terms that the source has more of than the language, by
    rank up to ``most_terms``. ``docs`` has lang, source and text."""
    index = materialize(term_index(docs), "term-index")
    posts = index.select("lang", "term", "total", F.explode("sources").alias("post")).select("lang", "term", "total", "post.*")
    counts = materialize(posts.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "count-histograms")
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("own"))
    langs = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    groups = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own", "kept", "all"])
    zero = F.when(F.col("kept") > 0, _share("0", "own", "greatest(kept, 1)")).otherwise(1)
    groups = materialize(groups.withColumn("zero", zero), "groups")

    weighed = posts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "own", "kept"))
    terms = (
        weighed.withColumn("q", _share("total", "all", "kept"))
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    )
    lists = weighed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("sources")).where("size(sources) > 1")
    pairs = "lang string, source string, item string, value long"
    shared = lists.select("lang", "sources").mapInArrow(tidy(_scatter), pairs)

    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / PEERS).alias("blocks"))
    peers = (
        groups.join(blocks, "lang")
        .groupBy("lang", F.pmod(F.xxhash64("source"), "blocks").alias("block"))
        .agg(F.collect_list(F.struct("source", "zero")).alias("peers"))
    )
    own = counts.join(groups.select("lang", "source", "own", "kept"), ["lang", "source"])
    own = own.groupBy("lang", "source").agg(F.collect_list(F.struct(_share("n", "own", "kept").alias("p"), "terms")).alias("counts"))
    full = groups.join(own, ["lang", "source"], "left").select(
        "lang", "source", "kept", "zero", F.coalesce("counts", F.array().cast("array<struct<p:bigint,terms:bigint>>")).alias("counts")
    )
    zeros = full.join(peers, "lang").drop("block").mapInArrow(_baseline, pairs)
    summed = zeros.unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return found.unionByName(terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms))
