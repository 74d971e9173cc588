"""The whole runs, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.functions import dims
from logmill.functions.expr import clean_line
from logmill.operators import classify, cluster, enrich, metadata, parse, retrieval, textfeat
from logmill.session import materialize


def security_scan(lines: DataFrame, api: bool = False) -> DataFrame:
    """The scan: findings of the lines (with their ``path``) of files that are
    not excluded. The path decides row by row, so no line moves."""
    return parse.scan_signatures(parse.scan_exclusions(lines, api))


def scan_report(lines: DataFrame) -> DataFrame:
    """P9 from lines: scanned once, the far fewer findings are then read twice."""
    return parse.capped_report(materialize(parse.scan_signatures(lines), "findings"))


def resolved_incidents(
    lines: DataFrame, cache: DataFrame, answers: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Lines to (deduped resolved events, resolved vulnerabilities).

    The lines are scanned once; the events, far fewer, are written and read by
    both branches.
    """
    found = materialize(parse.extract_events(lines), "events")
    vulns, others = parse.split_vulns(found)
    events = enrich.dedupe_incidents(parse.keep_error_warning(others))
    return (
        enrich.resolve_incidents(events, cache, answers),
        enrich.resolve_vulns(vulns, cache, answers),
    )


def ingest(files: DataFrame, table_columns: DataFrame | None = None) -> DataFrame:
    """Classify and route: ``files`` with file_type, destination, goes_to_analysis."""
    return classify.route_files(classify.final_file_type(files, table_columns))


def summaries_by_weight(docs: DataFrame, chars: int | None = None) -> DataFrame:
    """Summaries from the heaviest terms (no vector model); ``chars`` as in T8."""
    weights = textfeat.tfidf(
        docs.select(F.col("doc_id").alias("row_id"), "text"), stop_words=textfeat.ENGLISH
    ).withColumnRenamed("row_id", "doc_id")
    return textfeat.file_summary(docs, textfeat.top_weighted_terms(weights), chars)


def summaries_by_vectors(
    docs: DataFrame, dim: int = 64, model=None, sample: int | None = None, k: int = dims.MAX_TERMS, chars: int | None = None
) -> DataFrame:
    """Summaries from relevant and diverse keywords (vectors of texts and terms). The choice
    is made among the ``k`` most frequent terms of a document; ``sample`` and ``chars`` as in T7, T8."""
    candidates = textfeat.keyword_candidates(docs, k).where(~F.col("fallback"))
    sampled = textfeat.doc_sample(docs, sample).select("doc_id", F.col("sample").alias("text"))
    picked = textfeat.mmr_keywords(
        retrieval.embed_column(candidates, "term", dim, model),
        retrieval.embed_column(sampled, "text", dim, model),
    )
    return textfeat.file_summary(docs, picked, chars)


def large_run(
    docs: DataFrame, eps: float = 0.8, dim: int = 64, model=None, chars: int | None = None
) -> DataFrame:
    """Files to (file_name, summary, cluster_id, category, final_path).

    ``docs(doc_id, name, text)`` with numeric ids.
    """
    summaries = materialize(summaries_by_weight(docs.select("doc_id", "text"), chars), "summaries")
    vectors = retrieval.embed_column(summaries, "summary", dim, model).select(
        F.col("doc_id").alias("row_id"), "embedding"
    )
    labels = cluster.density_clusters_vectors(vectors, eps).withColumnRenamed("row_id", "doc_id")
    named = summaries.withColumn("category", textfeat.category_by_domain(F.col("summary")))
    return (
        docs.select("doc_id", F.col("name").alias("file_name"))
        .join(named, "doc_id")
        .join(labels, "doc_id")
        .select(
            "file_name",
            "summary",
            "cluster_id",
            "category",
            F.concat(F.lit("processed/"), "category", F.lit("/"), "file_name").alias("final_path"),
        )
    )


def large_run_updates(report: DataFrame) -> DataFrame:
    """T17's result as updates of the audit table (M3)."""
    return report.select(
        F.col("file_name").alias("stored_filename"),
        "category",
        "final_path",
        F.col("cluster_id").cast("string").alias("cluster_id"),
        "summary",
        F.lit(1).alias("update_no"),
    )


def clustered_lines(lines: DataFrame, eps: float = 0.7) -> DataFrame:
    """Lines (row_id, file_id, line) with cluster and category.

    Everything but the last join works on distinct cleaned texts.
    """
    table = textfeat.line_table(lines).withColumn("cleaned", clean_line(F.col("line")))
    texts = cluster.distinct_texts(table.select("row_id", F.col("cleaned").alias("text")))
    vectors = materialize(textfeat.tfidf_vectors(texts), "vectors")
    labels = materialize(cluster.text_clusters(vectors, eps), "labels")
    weights = vectors.select("row_id", F.explode("terms").alias("t")).select("row_id", "t.*")
    # written: noise is a hot key of the join, which needs two exchanges to be split
    named = materialize(cluster.cluster_label(labels, cluster.cluster_top_terms(weights, labels)), "named")
    by_text = labels.join(named, "cluster_id").select(F.col("text").alias("cleaned"), "cluster_id", "category")
    return table.join(by_text, "cleaned").select(
        "row_id",
        F.col("line").alias("original_log"),
        F.col("file_id").alias("source_file"),
        F.col("cleaned").alias("cleaned_log"),
        "cluster_id",
        "category",
    )


def small_run(lines: DataFrame, eps: float = 0.7) -> DataFrame:
    """The majority category of each file, as updates of the audit table."""
    named = clustered_lines(lines, eps).withColumnRenamed("source_file", "file_id")
    return cluster.majority_category(named).select(
        F.col("file_id").alias("stored_filename"),
        "category",
        F.concat(F.lit("processed/"), "category", F.lit("/"), "file_id").alias("final_path"),
        F.lit("Line-Level").alias("cluster_id"),
        F.concat(
            F.lit("Processed via HDBSCAN clustering. Majority category: "), "category"
        ).alias("summary"),
    )


def audit_rows(files: DataFrame, lines: DataFrame, updates: DataFrame) -> DataFrame:
    """M1 then M3: profiled files with the results of a run."""
    return metadata.update_by_name(metadata.profile_files(files, lines), updates)
