"""Chunks, search documents, vectors and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmill.functions import dims
from logmill.functions.expr import tokens
from logmill.session import materialize

SLICE = 4_000_000  # scores held at once

DOC_FIELDS = [
    "collection", "id", "file_id", "text", "level", "vuln_type", "severity", "category",
    "status", "reference_url", "timestamp",
]


def chunk_text(docs: DataFrame, size: int = dims.CHUNK_CHARS, step: int = dims.CHUNK_STEP) -> DataFrame:
    """V1: overlapping pieces of each text: (file_id, chunk_index, text)."""
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(step))
    return (
        docs.where(F.length("text") > 0)
        .select("file_id", "text", F.posexplode(starts).alias("chunk_index", "start"))
        .select("file_id", "chunk_index", F.substr("text", "start", F.lit(size)).alias("text"))
    )


def line_offsets(lines: DataFrame, block_lines: int = 4096) -> DataFrame:
    """``lines(file_id, line_no, line)`` with ``start``, the place of a line's first character
    in its file (from 0, one character for a line end), and ``total``, the file's characters
    without a last line end.

    Characters are summed by blocks of lines; sums over the blocks of a file give each block
    its offset, and only a block's own lines are put in order, so a file of any size spreads.
    """
    size = F.length("line").cast("long") + 1
    blocked = lines.withColumn("block", F.floor((F.col("line_no") - 1) / F.lit(block_lines)))
    blocks = blocked.groupBy("file_id", "block").agg(F.sum(size).alias("chars"))
    whole = Window.partitionBy("file_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "file_id", "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("offset"),
        (F.sum("chars").over(whole) - 1).alias("total"),
    )
    ahead = Window.partitionBy("file_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(materialize(offsets, "line-blocks"), ["file_id", "block"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum(size).over(ahead), F.lit(0)))
        .drop("block", "offset")
    )


def _joined(parts: DataFrame, *keys: str) -> DataFrame:
    """The parts (start, part) of each key, in order, as one text."""
    held = F.array_sort(F.collect_list(F.struct("start", "part")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(held, lambda p: p["part"]), "").alias("text"))


def chunk_lines(
    lines: DataFrame, size: int = dims.CHUNK_CHARS, step: int = dims.CHUNK_STEP, block_lines: int = 4096
) -> DataFrame:
    """V1 for files of any size: the pieces that ``chunk_text`` cuts from the lines of a
    file joined by line ends, made from lines that stay apart: each gives its part to the
    pieces it reaches, and a piece gathers at most ``size`` characters."""
    placed = line_offsets(lines, block_lines)
    end = F.least(F.col("start") + F.length("line") + 1, F.col("total"))  # the last line has no line end
    first = F.greatest(F.lit(0), F.floor((F.col("start") - size) / F.lit(step)) + 1)
    last = F.least(F.floor((end - 1) / F.lit(step)), F.floor((F.col("total") - 1) / F.lit(step)))
    begin = F.greatest(F.col("start"), F.col("chunk_index") * step)
    stop = F.least(end, F.col("chunk_index") * step + size)
    body = F.concat("line", F.lit("\n"))
    parts = (
        placed.where(F.col("total") > 0)
        .withColumn("end", end).where(F.col("end") > F.col("start"))
        .withColumn("chunk_index", F.explode(F.sequence(first, last)))
        .select(
            "file_id", F.col("chunk_index").cast("int").alias("chunk_index"), begin.alias("start"),
            F.substr(body, (begin - F.col("start") + 1).cast("int"), (stop - begin).cast("int")).alias("part"),
        )
    )
    return _joined(parts, "file_id", "chunk_index")


def sample_lines(lines: DataFrame, chars: int = dims.SAMPLE_CHARS, block_lines: int = 4096) -> DataFrame:
    """T7 for files of any size: (file_id, text), the first and last ``chars`` characters of
    the lines of a file joined by line ends, or all of a file of up to twice as many."""
    placed = line_offsets(lines, block_lines).withColumn("end", F.least(F.col("start") + F.length("line") + 1, F.col("total")))
    body, total = F.concat("line", F.lit("\n")), F.col("total")
    part = lambda a, b: F.struct(
        a.alias("start"), F.substr(body, (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("part")
    )
    head_end = F.when(total > 2 * chars, F.lit(chars)).otherwise(total)
    tail = F.when(total > 2 * chars, total - chars).otherwise(total)
    start, end = F.col("start"), F.col("end")
    both = F.array(
        F.when(start < F.least(end, head_end), part(start, F.least(end, head_end))),
        F.when(F.greatest(start, tail) < end, part(F.greatest(start, tail), end)),
    )
    found = placed.select("file_id", F.explode(F.array_compact(both)).alias("p")).select("file_id", "p.*")
    return _joined(found, "file_id")


def _docs(df: DataFrame, **fields: Column) -> DataFrame:
    return df.select(
        *[fields.get(n, F.lit(None).cast("string")).cast("string").alias(n) for n in DOC_FIELDS]
    )


def summary_docs(summaries: DataFrame) -> DataFrame:
    f = F.col("file_id")
    return _docs(
        summaries,
        collection=F.lit("summaries"), id=F.concat(F.lit("summary_"), f), file_id=f, text=F.col("summary"),
    )


def chunk_docs(chunks: DataFrame) -> DataFrame:
    f = F.col("file_id")
    return _docs(
        chunks,
        collection=F.lit("chunks"),
        id=F.concat(F.lit("chunk_"), f, F.lit("_"), F.col("chunk_index")),
        file_id=f,
        text=F.col("text"),
    )


def _event_id(kind: str) -> Column:
    # Line and category number name an event for good; a running number would
    # shift with every line found before it, and need a file in one task.
    return F.concat("file_id", F.lit(f"_{kind}_"), "line_no", F.lit("_"), "category_no")


def event_docs(events: DataFrame) -> DataFrame:
    return _docs(
        events,
        collection=F.lit("events"),
        id=_event_id("event"),
        file_id=F.col("file_id"),
        text=F.concat(F.lit("["), "entry_type", F.lit("] "), "message"),
        level=F.col("entry_type"),
        timestamp=F.coalesce("logged_on", F.lit("")),
    )


def vuln_docs(vulns: DataFrame) -> DataFrame:
    return _docs(
        vulns,
        collection=F.lit("vulnerabilities"),
        id=_event_id("vuln"),
        file_id=F.col("file_id"),
        text=F.concat(
            F.lit("["), "vuln_type", F.lit("] "), "message", F.lit("\nSolution: "),
            F.coalesce("solution", F.lit("")),
        ),
        vuln_type=F.col("vuln_type"),
        severity=F.col("severity"),
        reference_url=F.coalesce("reference_url", F.lit("")),
        timestamp=F.coalesce("logged_on", F.lit("")),
    )


def metadata_docs(master: DataFrame) -> DataFrame:
    def part(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.col(column), F.lit("")))

    return _docs(
        master,
        collection=F.lit("metadata"),
        id=F.concat("file_id", F.lit("_metadata")),
        file_id=F.col("file_id"),
        text=F.concat_ws(
            "\n",
            part("File", "original_filename"),
            part("Category", "category"),
            part("Summary", "summary"),
            part("Status", "status"),
        ),
        category=F.col("category"),
        status=F.col("status"),
    )


def index_docs(
    summaries: DataFrame | None = None,
    chunks: DataFrame | None = None,
    events: DataFrame | None = None,
    vulns: DataFrame | None = None,
    master: DataFrame | None = None,
) -> DataFrame:
    """V2: the search documents of up to five collections in one layout."""
    given = [
        make(df)
        for make, df in (
            (summary_docs, summaries), (chunk_docs, chunks), (event_docs, events),
            (vuln_docs, vulns), (metadata_docs, master),
        )
        if df is not None
    ]
    out = given[0]
    for df in given[1:]:
        out = out.unionByName(df)
    return out


def upsert_docs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """V3: per (collection, id) the row of the highest ``version``.

    Grouped with a maximum, so repeated versions collapse before the shuffle.
    """
    key = ["collection", "id"]
    rest = [c for c in stored.columns if c not in key and c != "version"]
    return (
        stored.unionByName(new)
        .groupBy(*key)
        .agg(F.max(F.struct("version", *rest)).alias("newest"))
        .select(*key, "newest.*")
        .select(*stored.columns)
    )


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Queries by documents; larger is nearer. Rounded, so that equal texts tie."""
    if metric == "cosine":
        xn = np.linalg.norm(x, axis=1)
        qn = np.linalg.norm(q, axis=1)
        s = (q @ x.T) / np.maximum(np.outer(qn, xn), 1e-300)
    else:
        s = -((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T))
    return np.round(s, 6) + 0.0


def _tile_topk(k: int, metric: str):
    """The best ``k`` of a tile's documents for each of its questions, ties by id."""

    def make(docs: pa.Table, questions: pa.Table) -> pa.Table:
        kinds = [questions.schema.field("query_id").type, docs.schema.field("id").type, pa.float64()]
        names = ["query_id", "id", "score"]
        if not docs.num_rows or not questions.num_rows:
            return pa.table([pa.array([], kind) for kind in kinds], names)
        x, q = (np.stack(t.column("embedding").to_numpy()).astype(float) for t in (docs, questions))
        ids = docs.column("id").to_numpy(zero_copy_only=False)
        n, who, what, scores = len(x), [], [], []
        step = max(1, SLICE // n)
        for start in range(0, len(q), step):
            found = _scores(x, q[start : start + step], metric)
            least = np.partition(found, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
            a, b = np.nonzero(found >= least)
            order = np.lexsort((ids[b], -found[a, b], a))
            a, b = a[order], b[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            a, b = a[rank < k], b[rank < k]
            who.append(a + start)
            what.append(b)
            scores.append(found[a, b])
        columns = [questions.column("query_id").take(np.concatenate(who)), docs.column("id").take(np.concatenate(what))]
        return pa.table([*columns, pa.array(np.concatenate(scores))], names)

    return make


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _tiles_of(df: DataFrame, key: str, rows: int) -> tuple[Column, Column]:
    """The tile of a row, and how many there are: a count of ``df`` that runs with the query."""
    tiles = df.agg(F.greatest(F.ceil(F.count("*") / F.lit(rows)), F.lit(1)).cast("int").alias("n")).scalar()
    return F.pmod(F.xxhash64(key), tiles).cast("int"), tiles


def topk_similar(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    where: dict[str, object] | None = None,
    doc_rows: int = 1 << 16,
    query_rows: int = 1 << 14,
) -> DataFrame:
    """V4: the exact ``k`` nearest documents of each question.

    ``docs(id, embedding, ...)``, ``queries(query_id, embedding)``; result
    (query_id, rank, id, score), score negative squared distance for "l2". One pass for
    any number of questions: a task gets a tile of about ``doc_rows`` documents and one of
    about ``query_rows`` questions and keeps the best ``k`` of its documents; these are
    ranked per task, then by question. Documents are shuffled once for each tile of
    questions. Nothing passes through the driver, and nothing runs before the result is
    asked for.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is 'cosine' or 'l2'")
    for column, value in (where or {}).items():
        docs = docs.where(F.col(column) == value)
    docs, queries = docs.select("id", "embedding"), queries.select("query_id", "embedding")
    doc_tile, doc_tiles = _tiles_of(docs, "id", doc_rows)
    query_tile, query_tiles = _tiles_of(queries, "query_id", query_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = docs.withColumn("doc_tile", doc_tile).withColumn("query_tile", every(query_tiles))
    right = queries.withColumn("query_tile", query_tile).withColumn("doc_tile", every(doc_tiles))
    tile = ["doc_tile", "query_tile"]
    id_type, query_type = dict(docs.dtypes)["id"], dict(queries.dtypes)["query_id"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        _tile_topk(k, metric), f"query_id {query_type}, id {id_type}, score double"
    )
    return _best(found, k)


#: Directions of the hash tables, by a formula that any engine can repeat: the
#: coordinate ``pos`` of the direction for ``bit`` of ``table``.
DIRECTION = "((({table} + 1) * 7919 + ({bit} + 1) * 104729 + (({pos} + 1) * ({pos} + 3 * {bit} + 5 * {table} + 7)) * 1299709) % 2003) / 1001.0 - 1"


def directions(dim: int, tables: int, bits: int) -> np.ndarray:
    t, b, p = np.ogrid[:tables, :bits, :dim]
    return ((t + 1) * 7919 + (b + 1) * 104729 + ((p + 1) * (p + 3 * b + 5 * t + 7)) * 1299709) % 2003 / 1001.0 - 1


def _signatures(df: DataFrame, key: str, dim: int, tables: int, bits: int, probes: bool) -> DataFrame:
    """(key, table, code) of each vector: one bit for each direction's sign; with
    ``probes`` also the codes that differ in one bit."""
    rays = directions(dim, tables, bits).reshape(tables * bits, dim).T

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(float)
            signs = (np.round(x @ rays, 9) > 0).reshape(len(x), tables, bits)
            codes = (signs << np.arange(bits)).sum(axis=2).astype(np.int64)[:, :, None]
            if probes:
                codes = np.concatenate([codes, codes ^ (1 << np.arange(bits))], axis=2)
            each = codes.shape[1] * codes.shape[2]
            table = np.broadcast_to(np.arange(tables)[None, :, None], codes.shape)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(np.repeat(np.arange(len(x)), each)), pa.array(table.ravel()), pa.array(codes.ravel())],
                [key, "table", "code"],
            )

    return df.select(key, "embedding").mapInArrow(make, f"{key} {dict(df.dtypes)[key]}, table long, code long")


def hash_bits(rows: int, bucket_rows: int = 64) -> int:
    """Bits of a code, so that a bucket has about ``bucket_rows`` of the rows."""
    return max(1, min(48, (max(rows, 1) // bucket_rows).bit_length()))


def topk_similar_lsh(
    docs: DataFrame, queries: DataFrame, k: int = 5, tables: int = 12, bucket_rows: int = 64
) -> DataFrame:
    """V5: approximate V4 (Euclidean) by signs of projections, (query_id, rank, id, score).

    Each table has a code of concatenated sign bits, as many as the documents need for
    buckets of about ``bucket_rows``; a question also looks into the buckets that differ in
    one bit. Only ids are shuffled to meet; each candidate pair is kept once, and vectors
    are fetched for the candidates. Crowded buckets are split by adaptive execution, as
    both sides of the join have an exchange of their own. Vectors are meant to be of about
    equal length, since a sign does not depend on it.
    """
    first = docs.select(F.size("embedding").alias("n")).first()
    if first is None:
        none = F.lit(None).cast(dict(queries.dtypes)["query_id"])
        return _best(docs.select(none.alias("query_id"), "id", F.lit(0.0).alias("score")), k)
    bits = hash_bits(docs.count(), bucket_rows)
    lists = _signatures(docs, "id", first["n"], tables, bits, False)
    looks = _signatures(queries, "query_id", first["n"], tables, bits, True)
    pairs = materialize(lists.join(looks, ["table", "code"]).select("query_id", "id").distinct(), "candidates")
    wide = lambda df, key, name: df.select(key, F.col("embedding").cast("array<double>").alias(name))
    held = pairs.join(wide(docs, "id", "de"), "id").join(wide(queries, "query_id", "qe"), "query_id")
    gap = F.aggregate(F.zip_with("de", "qe", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return _best(held.select("query_id", "id", (-F.round(gap, 6)).alias("score")), k)


def with_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``found`` of V5 with the share of each question's exact neighbours that it has."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = hit.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
    return found.join(recall, "query_id")


def _context_part(docs: DataFrame, hits: DataFrame, title: str, label: str) -> DataFrame:
    text = F.concat(F.lit("File: "), "file_id", F.lit(f"\n{label}: "), "text")
    # hits: at most k rows per question, the side to broadcast is left to the planner.
    return (
        hits.join(docs.select("id", "file_id", "text"), "id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("found"))
        .select(
            "query_id",
            F.concat(
                F.lit(f"=== {title} ===\n\n"),
                F.array_join(F.transform("found", lambda f: f["t"]), "\n\n"),
            ).alias("part"),
        )
    )


def retrieval_context(
    summaries: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 3
) -> DataFrame:
    """V6: (query_id, context): the best summaries and chunks of each question.

    ``summaries`` and ``chunks`` are ``(id, file_id, text, embedding)``,
    ``questions(query_id, embedding)``.
    """
    first = _context_part(
        summaries, topk_similar(summaries, questions, k), "Log File Summaries", "Summary"
    ).withColumnRenamed("part", "s")
    second = _context_part(
        chunks, topk_similar(chunks, questions, k), "Relevant Log Details", "Content"
    ).withColumnRenamed("part", "c")
    return (
        questions.select("query_id")
        .join(first, "query_id", "left")
        .join(second, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(
                F.nullif(F.concat_ws("\n\n", "s", "c"), F.lit("")), F.lit("No log data indexed yet.")
            ).alias("context"),
        )
    )


def search_report(docs: DataFrame, questions: DataFrame, label: str, k: int = 5) -> DataFrame:
    """V6, tool form: the best ``k`` of one collection, separated by dashes."""
    text = F.concat(F.lit("File: "), "file_id", F.lit(f"\n{label}: "), "text")
    return (
        topk_similar(docs, questions, k)
        .join(docs.select("id", "file_id", "text"), "id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("found"))
        .select(
            "query_id", F.array_join(F.transform("found", lambda f: f["t"]), "\n---\n").alias("report")
        )
    )


def embed_column(df: DataFrame, text: str = "text", dim: int = 64, model=None) -> DataFrame:
    """V7: add ``embedding``. ``model`` is a pandas UDF from text to vector;
    without one, words are hashed to a term-frequency vector of unit length."""
    if model is not None:
        return df.withColumn("embedding", model(F.col(text)))
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("_words", tokens(F.col(text), []))
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(hashed)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_words", "_tf", "_unit"
    )


def collection_stats(docs: DataFrame) -> DataFrame:
    """V8: documents per collection."""
    return docs.groupBy("collection").agg(F.count("*").alias("n"))


def collection_head(docs: DataFrame, collection: str, n: int = 5) -> DataFrame:
    """V8: the first documents of a collection."""
    return docs.where(F.col("collection") == collection).orderBy("id").limit(n)
