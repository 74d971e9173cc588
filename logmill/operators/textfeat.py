"""Terms, weights, keywords, summaries and categories of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from logmill.functions import dims
from logmill.functions.expr import best_of, clean_line, head, hits, strip, tokens, with_bigrams
from logmill.session import materialize

ENGLISH = dims.ENGLISH_STOP_WORDS
LINE_STOPS = dims.ENGLISH_STOP_WORDS + dims.LINE_STOP_WORDS


def clean_lines(lines: DataFrame) -> DataFrame:
    """T1."""
    return lines.withColumn("cleaned", clean_line(F.col("line")))


def line_table(lines: DataFrame) -> DataFrame:
    """T2 for texts: stripped lines, blank ones left out."""
    return lines.withColumn("line", strip(F.col("line"))).where(F.col("line") != "")


def table_line_table(
    rows: DataFrame, columns: list[str], order: str, n: int | None = None
) -> DataFrame:
    """T2 for tables: the rows of each, or the first ``n``, cells joined by " | "."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]
    numbered = rows.select(
        "file_id", F.col(order).alias("_o"), F.concat_ws(" | ", *cells).alias("line")
    ).withColumn("line_no", F.row_number().over(Window.partitionBy("file_id").orderBy("_o")))
    kept = numbered if n is None else numbered.where(F.col("line_no") <= n)
    return kept.select("file_id", "line_no", "line")


def _counted(grams: Column, k: int | None) -> Column:
    """(neg, term) of the distinct values of an array that is not empty, ``neg`` their count
    below zero: all, or the ``k`` most frequent. Sorted once, so that a run is a value."""

    def runs(s: Column, starts: Column) -> Column:
        end = lambda p: F.coalesce(F.get(starts, p + 1), F.size(s))
        return F.transform(starts, lambda i, p: F.struct((i - end(p)).cast("long").alias("neg"), F.get(s, i).alias("term")))

    def count(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda z: runs(s, z))[0]

    # arrays of one item bind what is used more than once, so it is made once
    found = F.transform(F.array(F.sort_array(grams)), count)[0]
    return found if k is None else F.slice(F.sort_array(found), 1, k)


def _ranked_terms(docs: DataFrame, grams: DataFrame, k: int | None) -> DataFrame:
    """Counts of (doc_id, fallback, grams), of each document all or the ``k`` most frequent;
    ``docs`` holds the same ids.

    A document of one row is counted and ranked within the row: nothing is shuffled but the
    ids. Rows that share an id are counted together: partial sums per task, and the rank
    limit before the per-document shuffle, so one huge document stays bounded.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_shared"))
    shared = materialize(ids, "shared-ids")
    split = not shared.isEmpty()
    same = F.col("doc_id").eqNullSafe(F.col("_shared"))
    alone = (grams.join(shared, same, "left_anti") if split else grams).where(F.size("grams") > 0)
    counts = alone.select("doc_id", "fallback", F.explode(_counted(F.col("grams"), k)).alias("t")).select(
        "doc_id", "fallback", "t.term", (-F.col("t.neg")).alias("n")
    )
    if not split:
        return counts
    each = grams.join(shared, same, "left_semi").select("doc_id", "fallback", F.explode("grams").alias("term"))
    together = each.groupBy("doc_id", "fallback", "term").agg(F.count("*").alias("n"))
    if k is not None:
        order = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "term")
        together = together.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    return counts.unionByName(together)


def term_counts(
    docs: DataFrame, k: int = dims.MAX_TERMS, stop_words: list[str] = ENGLISH
) -> DataFrame:
    """Words and word pairs of each document, the ``k`` most frequent."""
    grams = docs.select(
        "doc_id",
        F.lit(False).alias("fallback"),
        with_bigrams(tokens(F.col("text"), stop_words)).alias("grams"),
    )
    return _ranked_terms(docs, grams, k).select("doc_id", "term", "n")


def vocabulary(
    rows: DataFrame, max_terms: int = dims.MAX_TERMS, stop_words: list[str] = LINE_STOPS
) -> DataFrame:
    """The ``max_terms`` most frequent words over all rows: (term, n, df, idf).

    One pass: all words of a row count for ``n``, its distinct words for ``df``.
    A column ``copies`` lets one row stand for several.
    idf = ln((1 + rows) / (1 + df)) + 1.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select("text", copies.alias("copies"))
    total = rows.agg(F.sum("copies")).scalar()
    return (
        rows.select("copies", tokens(F.col("text"), stop_words).alias("words"))
        .select("copies", F.posexplode(F.array("words", F.array_distinct("words"))).alias("kind", "part"))
        .select("copies", "kind", F.explode("part").alias("term"))
        .groupBy("term")
        .agg(
            F.sum(F.when(F.col("kind") == 0, F.col("copies")).otherwise(0)).alias("n"),
            F.sum(F.when(F.col("kind") == 1, F.col("copies")).otherwise(0)).alias("df"),
        )
        .orderBy(F.col("n").desc(), "term")
        .limit(max_terms)
        .withColumn("idf", F.log((1 + total) / (1 + F.col("df"))) + 1)
    )


TERMS = "array<struct<term:string,n:bigint,weight:double>>"


def _weigh(known: list[str], idf: list[float]):
    """Counts and weights of the words of each row, for a batch of rows at once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, by = pa.array(known, pa.string()), np.array(idf)
        for batch in batches:
            words, n = batch.column("_words"), batch.num_rows
            sizes = pc.fill_null(words.value_lengths(), 0).to_numpy()
            term = pc.fill_null(pc.index_in(words.flatten(), terms), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(n), sizes)[term >= 0]
            cells, counts = np.unique(row * len(known) + term[term >= 0], return_counts=True)
            row, term = cells // max(1, len(known)), cells % max(1, len(known))
            weight = counts * by[term]
            weight = weight / np.sqrt(np.bincount(row, weight * weight, n))[row]
            values = pa.StructArray.from_arrays(
                [terms.take(pa.array(term)), pa.array(counts.astype(np.int64)), pa.array(weight)], ["term", "n", "weight"]
            )
            lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), values)
            kept = [c for c in batch.schema.names if c != "_words"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], [*kept, "terms"])

    return make


def tfidf_vectors(
    rows: DataFrame, max_terms: int = dims.MAX_TERMS, stop_words: list[str] = LINE_STOPS
) -> DataFrame:
    """T4 as a column: ``rows`` with ``terms``, the (term, n, weight) of each row by term,
    weights of unit length.

    The vocabulary comes first (``max_terms`` words, sent to every task); counts, weights
    and lengths are then made within the row, a batch of rows at a time, so nothing is
    shuffled but the vocabulary's counts.
    """
    found = sorted(vocabulary(rows, max_terms, stop_words).select("term", "idf").collect())
    schema = StructType([*rows.schema.fields, StructField("terms", StructType.fromDDL(f"t {TERMS}")["t"].dataType)])
    words = rows.withColumn("_words", tokens(F.col("text"), stop_words))
    return words.mapInArrow(_weigh([r["term"] for r in found], [r["idf"] for r in found]), schema)


def tfidf(
    rows: DataFrame, max_terms: int = dims.MAX_TERMS, stop_words: list[str] = LINE_STOPS
) -> DataFrame:
    """T4: (row_id, term, n, weight), rows of unit length."""
    vectors = tfidf_vectors(rows.select("row_id", "text", *(["copies"] if "copies" in rows.columns else [])), max_terms, stop_words)
    return vectors.select("row_id", F.explode("terms").alias("t")).select("row_id", "t.*")


def keyword_candidates(docs: DataFrame, k: int | None = None, chars: int | None = None) -> DataFrame:
    """T5: T3 without the summary stop words, as (doc_id, term, n, fallback): all terms, or
    those among the ``k`` most frequent of a document.

    A document without any candidate gives its text, or the first ``chars`` characters, instead.
    No candidate is left exactly when it has no pair of words and its only word,
    if any, is a stop word, which one look at the row decides.
    """
    words = F.col("_words")
    none = (F.size(words) == 0) | (
        (F.size(words) == 1) & F.try_element_at(words, F.lit(1)).isin(dims.SUMMARY_STOP_WORDS)
    )
    grams = (
        docs.where(strip(F.col("text")) != "")
        .select(
            "doc_id",
            text_head(F.col("text"), chars).alias("_head"),
            tokens(F.col("text"), ENGLISH).alias("_words"),
        )
        .withColumn("fallback", none)
        .select(
            "doc_id",
            "fallback",
            F.when(F.col("fallback"), F.array("_head")).otherwise(with_bigrams(words)).alias("grams"),
        )
    )
    return (
        _ranked_terms(docs, grams, k)
        .where(F.col("fallback") | ~F.col("term").isin(dims.SUMMARY_STOP_WORDS))
        .select("doc_id", "term", F.when(F.col("fallback"), 0).otherwise(F.col("n")).alias("n"), "fallback")
    )


def text_head(text: Column, chars: int | None) -> Column:
    return F.replace(head(text, chars), F.lit("\n"), F.lit(" "))


def _pick(doc: np.ndarray, cand: np.ndarray, top_n: int, diversity: float) -> list[int]:
    """Greedy choice by relevance to the document minus likeness to the chosen."""

    def unit(m: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(m, axis=-1, keepdims=True)
        return m / np.where(length == 0, 1.0, length)

    cand = unit(cand)
    relevance = cand @ unit(doc)
    chosen = [int(np.argmax(relevance))]
    likeness = cand @ cand[chosen[0]]
    open_ = np.ones(len(cand), dtype=bool)
    open_[chosen[0]] = False
    while open_.any() and len(chosen) < top_n:
        score = np.where(open_, (1 - diversity) * relevance - diversity * likeness, -np.inf)
        best = int(np.argmax(score))
        chosen.append(best)
        open_[best] = False
        likeness = np.maximum(likeness, cand @ cand[best])
    return chosen


def _choose(top_n: int, diversity: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The choice of each document of sorted rows; the last of a batch may go on in the next."""
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if rows.num_rows:
                starts = _starts(rows["doc_id"])
                yield _choices(rows, starts, top_n, diversity)
                held = rows.slice(starts[-1])
        if held is not None:
            yield _choices(held.combine_chunks(), np.array([0, held.num_rows]), top_n, diversity)

    return make


def _starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal ids begins; nulls are equal."""
    here, before = ids.slice(1), ids.slice(0, len(ids) - 1)
    both = pc.and_(pc.is_null(here), pc.is_null(before))
    same = pc.or_(pc.fill_null(pc.equal(here, before), False), both)
    return np.concatenate([[0], np.flatnonzero(~same.to_numpy().astype(bool)) + 1])


def _choices(rows: pa.Table, bounds: np.ndarray, top_n: int, diversity: float) -> pa.RecordBatch:
    """(doc_id, rank, term) of the documents between the bounds: a document's own vector
    comes first, then its terms."""
    own, vectors = rows["_own"].to_numpy(), rows["embedding"].combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    places, ranks = [], []
    for start, end in zip(bounds[:-1], bounds[1:]):
        first = start + int(own[start:end].sum())
        if start < first < end:
            terms = vectors.slice(first, end - first).flatten().to_numpy(zero_copy_only=False)
            doc = np.asarray(vectors[int(start)].values.to_numpy(zero_copy_only=False), float)
            picked = _pick(doc, terms.reshape(end - first, -1).astype(float), top_n, diversity)
            places += [first + i for i in picked]
            ranks += range(1, len(picked) + 1)
    taken = rows.select(["doc_id", "term"]).take(pa.array(places, pa.int64())).combine_chunks()
    columns = [pa.array(taken[c].to_pylist(), rows.schema.field(c).type) for c in ("doc_id", "term")]
    return pa.RecordBatch.from_arrays([columns[0], pa.array(ranks, pa.int64()), columns[1]], ["doc_id", "rank", "term"])


def mmr_keywords(
    candidates: DataFrame,
    docs: DataFrame,
    top_n: int = dims.TOP_KEYWORDS,
    diversity: float = 0.5,
) -> DataFrame:
    """(doc_id, rank, term), relevant to the document and unlike each other.

    ``candidates(doc_id, term, embedding)`` holds at most 500 terms per document
    (T5), ``docs(doc_id, embedding)`` one vector each. Both are dealt and sorted by document,
    and a task goes through its documents in batches, one at a time.
    """
    id_type = dict(candidates.dtypes)["doc_id"]
    terms = candidates.where(F.col("term").isNotNull()).select("doc_id", F.lit(False).alias("_own"), "term", "embedding")
    own = docs.select("doc_id", F.lit(True).alias("_own"), F.lit(None).cast("string").alias("term"), "embedding")
    rows = terms.unionByName(own).repartition("doc_id").sortWithinPartitions("doc_id", F.desc("_own"), "term")
    return rows.mapInArrow(_choose(top_n, diversity), f"doc_id {id_type}, rank long, term string")


def doc_sample(docs: DataFrame, chars: int | None = None) -> DataFrame:
    """The part of a text that a vector model is given: all of it, or its first and
    last ``chars`` characters."""
    text = F.col("text")
    if chars is None:
        return docs.withColumn("sample", text)
    return docs.withColumn(
        "sample",
        F.when(
            F.length(text) > 2 * chars, F.concat(F.left(text, F.lit(chars)), F.right(text, F.lit(chars)))
        ).otherwise(text),
    )


def entry_count(text: Column) -> Column:
    """Lines of a text; a final line end does not start another."""
    return (
        F.when(text == "", 0)
        .when(text.endswith("\n"), F.size(F.split(text, "\n")) - 1)
        .otherwise(F.size(F.split(text, "\n")))
    )


def top_weighted_terms(weights: DataFrame, k: int = dims.TOP_KEYWORDS) -> DataFrame:
    """Keywords without a vector model: the heaviest terms of each document."""
    order = Window.partitionBy("doc_id").orderBy(F.round("weight", 6).desc(), "term")
    return (
        weights.where(~F.col("term").isin(dims.SUMMARY_STOP_WORDS))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("doc_id", "rank", "term")
    )


def file_summary(docs: DataFrame, keywords: DataFrame, chars: int | None = None) -> DataFrame:
    """T8: "Total Entries: N. Keywords: a, b, ..." from ranked keywords
    (doc_id, rank, term); at most 30 per document are gathered. A document
    without keywords keeps its text, or the first ``chars`` characters; a blank one is
    left out."""
    joined = keywords.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]),
            ", ",
        ).alias("keywords")
    )
    # Only the count and the head of a text travel to the join.
    short = docs.where(strip(F.col("text")) != "").select(
        "doc_id",
        entry_count(F.col("text")).alias("entries"),
        text_head(F.col("text"), chars).alias("head"),
    )
    line = F.concat(
        F.lit("Total Entries: "), F.col("entries"), F.lit(". Keywords: "), F.col("keywords")
    )
    return short.join(joined, "doc_id", "left").select(
        "doc_id", F.coalesce(line, F.col("head")).alias("summary")
    )


def category_dynamic(text: Column) -> Column:
    """The first word of three or more letters after "keywords:" that is
    not a stop word, else unstructured_log."""
    relevant = F.element_at(F.split(F.lower(text), "keywords:"), -1)
    words = F.regexp_extract_all(relevant, F.lit("([a-z]{3,})"), F.lit(1))
    named = F.filter(words, lambda w: ~w.isin(dims.CATEGORY_STOP_WORDS))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("unstructured_log"))


def category_by_domain(text: Column) -> Column:
    """The domain with most keyword hits; none: T10."""
    low = F.lower(text)
    scores = {c: hits(low, words) for c, words in dims.DOMAIN_KEYWORDS.items()}
    best = best_of(scores)
    return F.when(best["score"] > 0, best["name"]).otherwise(category_dynamic(text))
