"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions import dims, expr
from logmill.operators import classify, cluster, enrich, metadata, parse, retrieval, textfeat, tools
from logmill.plans import inputs, runs
from logmill.session import materialize, scratch_path
from logmill.sources import readers, sinks
from logmill.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VECTOR_EPS = 1.14
LINE_EPS = 0.7


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- sources ----------------------------------------------------------------


def _written_logs(spark: SparkSession, sf_dir: str) -> str:
    """The log lines as one text file per file id, in the shared folder."""
    path = scratch_path(spark, "landing")
    lines = inputs.log_lines(spark, sf_dir)
    (
        lines.withColumn("name", F.substring_index("file_id", ".", 1))
        .repartition("name")
        .sortWithinPartitions("name", "line_no")
        .select("name", "line")
        .write.partitionBy("name")
        .text(path)
    )
    return path


@query
def read_log_lines(spark, sf_dir):
    read = readers.read_log_lines(spark, _written_logs(spark, sf_dir))
    return read.select(
        F.concat(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit(".log")).alias("file_id"),
        "line_no",
        "line",
    )


@query
def read_csv_table(spark, sf_dir):
    path = scratch_path(spark, "csv")
    name = F.concat(F.lit('the "'), "p_name", F.lit('", new\nand old'))
    inputs.load(spark, sf_dir, "part").select(
        "p_partkey", name.alias("p_name"), "p_brand", "p_type", "p_size"
    ).write.csv(path, header=True, escape='"')
    return readers.read_csv_table(spark, path, multiline=True).select(
        F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", "p_type",
        F.col("p_size").cast("int").alias("p_size"),
    )


@query
def read_parquet_table(spark, sf_dir):
    return readers.read_parquet_table(spark, f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )


@query
def ingest_status(spark, sf_dir):
    return inputs.files(spark, sf_dir, with_text=False).select(
        "file_id", expr.extension(F.col("name")).alias("ext"), classify.ingest_status(F.col("name")).alias("status")
    )


@query
def list_landing_files(spark, sf_dir):
    """With the empty file that the writer leaves; a local writer's checksum files are left out."""
    listed = readers.list_landing_files(spark, _written_logs(spark, sf_dir), recursive=True)
    log = F.concat(F.nullif(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit("")), F.lit(".log"))
    return listed.where(~F.col("name").startswith(".")).select(F.coalesce(log, "name").alias("file_id"), "size_bytes")


@query
def walk_scan_targets(spark, sf_dir):
    """Bytes by folder of a tree as routing leaves it, read by the walk."""
    root = scratch_path(spark, "processed")
    files = materialize(inputs.files(spark, sf_dir).select(F.element_at(F.split("path", "/"), -2).alias("folder"), "text"), "routed")
    for folder in inputs.FOLDERS:
        files.where(F.col("folder") == folder).select("text").write.text(f"{root}/{folder}")
    found = readers.walk_scan_targets(spark, root, api=True)
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.sum("size_bytes").alias("size_bytes"))


@query
def load_master_csv(spark, sf_dir):
    master = inputs.file_master(spark, sf_dir)
    path = scratch_path(spark, "master-csv")
    master.withColumn("summary", F.lit("from the old report")).write.csv(path, header=True)
    kept = master.where(F.col("status") != "Failed")
    return readers.load_master_csv(spark, path, kept).select(
        "file_id", "original_filename", "summary", "status"
    )


# --- sinks: written, then read back ------------------------------------------


@query
def write_by_category(spark, sf_dir):
    path = scratch_path(spark, "by-category")
    lines = inputs.log_lines(spark, sf_dir).withColumn(
        "category", textfeat.category_by_domain(F.col("line"))
    )
    sinks.write_by_category(lines, path)
    return spark.read.parquet(path).groupBy("category", "file_id").agg(F.count("*").alias("lines"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines by template, with cluster and category."""
    rows = _clean_rows(spark, sf_dir)
    labels = materialize(cluster.template_clusters(rows.select("row_id", "cleaned")), "template-labels")
    named = materialize(cluster.cluster_label(labels, _top_terms(rows, labels)), "named")
    return rows.join(labels.drop("cleaned"), "row_id").join(named, "cluster_id")


@query
def write_cluster_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    rows = _clustered(spark, sf_dir)
    report = rows.groupBy("file_id", "cluster_id", "category").agg(F.count("*").alias("n")).select(
        F.col("file_id").alias("file_name"),
        F.concat(F.lit("Total Entries: "), "n").alias("summary"),
        "cluster_id",
        "category",
    )
    sinks.write_cluster_report(report, path)
    return spark.read.csv(
        path, header=True, escape='"', schema="file_name string, summary string, cluster_id long, category string"
    )


@query
def write_lines_by_category(spark, sf_dir):
    path = scratch_path(spark, "lines-by-category")
    rows = _clustered(spark, sf_dir).select(
        F.col("line").alias("original_log"), F.col("file_id").alias("source_file"),
        F.col("cleaned").alias("cleaned_log"), "cluster_id", "category",
    )
    sinks.write_lines_by_category(rows, path)
    return spark.read.csv(
        path, header=True, escape='"',
        schema="original_log string, source_file string, cleaned_log string, cluster_id long, category string",
    )


@query
def append_events(spark, sf_dir):
    path = scratch_path(spark, "events")
    sinks.append_events(unified_events(spark, sf_dir).select("*", F.lit(None).cast("timestamp").alias("logged_ts")), path)
    return spark.read.parquet(path).select(
        "file_id", "line_no", "category_no", "entry_type", "severity", "resolution", "reference_url"
    )


@query
def append_vulns(spark, sf_dir):
    path = scratch_path(spark, "vulns")
    vulns, _ = parse.split_vulns(_events(spark, sf_dir))
    sinks.append_vulns(enrich.fallback_vuln_resolution(vulns), path)
    return spark.read.parquet(path).select(
        "file_id", "line_no", "vuln_type", "severity", "solution", "resolution_summary", "reference_url"
    )


# --- classification ---------------------------------------------------------------


@query
def log_fast_path(spark, sf_dir):
    c = classify.log_fast_path(F.col("name"), F.col("text"))
    return inputs.files(spark, sf_dir).select("file_id", c.isNotNull().alias("is_log"))


@query
def keyword_file_class(spark, sf_dir):
    return classify.keyword_file_class(inputs.files(spark, sf_dir)).select(
        "file_id", "_class.category", F.round("_class.confidence", 6).alias("confidence")
    )


@query
def log_fast_path_of_heads(spark, sf_dir):
    c = classify.log_fast_path(F.col("name"), F.col("text"), dims.FAST_PATH_CHARS)
    return inputs.files(spark, sf_dir).select("file_id", c.isNotNull().alias("is_log"))


@query
def keyword_file_class_of_heads(spark, sf_dir):
    return classify.keyword_file_class(inputs.files(spark, sf_dir), chars=dims.CLASSIFY_CHARS).select(
        "file_id", "_class.category", F.round("_class.confidence", 6).alias("confidence")
    )


@query
def classify_file(spark, sf_dir):
    return classify.classify_files(inputs.files(spark, sf_dir)).select(
        "file_id", "category", F.round("confidence", 6).alias("confidence")
    )


@query
def normalize_label(spark, sf_dir):
    return (
        inputs.files(spark, sf_dir, with_text=False)
        .where(F.col("label").isNotNull())
        .select("file_id", "label", classify.normalize_label(F.col("label")).alias("category"))
    )


@query
def log_like_columns(spark, sf_dir):
    return classify.log_like_tables(inputs.table_columns(spark, sf_dir))


@query
def low_confidence_recheck(spark, sf_dir):
    done = classify.classify_files(inputs.files(spark, sf_dir))
    again = classify.low_confidence_recheck(F.col("category"), F.col("confidence"), F.col("text"))
    return done.select("file_id", "category", again.alias("checked"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.final_file_type(inputs.files(spark, sf_dir), inputs.table_columns(spark, sf_dir))


@query
def final_file_type(spark, sf_dir):
    return _typed(spark, sf_dir).select("file_id", "ingest_status", "file_type")


@query
def route_files(spark, sf_dir):
    return classify.route_files(_typed(spark, sf_dir)).select(
        "file_id", "file_type", F.coalesce("destination", F.lit("-")).alias("destination"), "goes_to_analysis"
    )


@query
def table_sample_text(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return classify.table_sample_text(inputs.order_tables(spark, sf_dir), columns, "o_orderkey")


# --- audit table -------------------------------------------------------------------


@query
def profile_files(spark, sf_dir):
    files = inputs.files(spark, sf_dir, with_text=False).withColumn("stored_name", F.col("name"))
    return metadata.profile_files(files, inputs.doc_lines(spark, sf_dir))


@query
def insert_if_absent(spark, sf_dir):
    table = inputs.load(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "O").select(
        F.col("o_orderkey").alias("file_id"), F.lit("stored").alias("origin"), F.lit(0).cast("long").alias("part")
    )
    new = inputs.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.lit("new").alias("origin"), F.col("l_partkey").alias("part")
    )
    return metadata.insert_if_absent(table, new, "file_id", ["part"])


@query
def update_by_name(spark, sf_dir):
    return metadata.update_by_name(
        inputs.file_master(spark, sf_dir), inputs.master_updates(spark, sf_dir)
    ).select("file_id", "category", "final_path", "cluster_id", "summary", "status")


@query
def list_files(spark, sf_dir):
    return metadata.list_files(inputs.file_master(spark, sf_dir), status="Processed", limit=dims.LISTING_ROWS)


@query
def resolve_path(spark, sf_dir):
    return metadata.resolve_paths(inputs.file_master(spark, sf_dir)).select(
        "original_filename", "end_id", F.coalesce("path", F.lit("-")).alias("path")
    )


@query
def resolve_one_path(spark, sf_dir):
    return metadata.resolve_path(inputs.file_master(spark, sf_dir), "up-7").select(
        "name", "end_id", F.coalesce("path", F.lit("-")).alias("path")
    )


@query
def cascade_delete(spark, sf_dir):
    orders = inputs.load(spark, sf_dir, "orders")
    doomed = orders.where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("file_id"))
    tables = {
        "file_master": orders.select(F.col("o_orderkey").alias("file_id")),
        "line_items": inputs.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id")),
    }
    left = metadata.cascade_delete(tables, doomed)
    parts = [
        t.groupBy("file_id").agg(F.count("*").alias("rows_left")).select(
            F.lit(name).alias("table_name"), "file_id", "rows_left"
        )
        for name, t in left.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def file_uuid(spark, sf_dir):
    return metadata.file_ids(inputs.files(spark, sf_dir, with_text=False))


@query
def safe_name(spark, sf_dir):
    return inputs.files(spark, sf_dir, with_text=False).select(
        "file_id", expr.safe_name(F.col("name")).alias("safe_name")
    )


def _stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("created_on", F.col("logged_on"))


@query
def recent_rows(spark, sf_dir):
    return metadata.recent_rows(_stored_events(spark, sf_dir)).select(
        "file_id", "line_no", "entry_type", "created_on"
    )


# --- parsing and scan -----------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.extract_events(inputs.log_lines(spark, sf_dir))


@query
def line_timestamp(spark, sf_dir):
    return parse.line_times(inputs.log_lines(spark, sf_dir)).select(
        "file_id", "line_no", "logged_on", _time("logged_ts").alias("logged_ts")
    )


@query
def line_level(spark, sf_dir):
    return parse.line_levels(inputs.log_lines(spark, sf_dir)).withColumn(
        "level", F.coalesce("level", F.lit("-"))
    )


@query
def scan_signatures(spark, sf_dir):
    return parse.scan_signatures(inputs.log_lines(spark, sf_dir)).select(
        "file_id", "line_no", "type", "content"
    )


@query
def scan_pages(spark, sf_dir):
    return (
        parse.scan_signatures(inputs.page_lines(spark, sf_dir))
        .groupBy("file_id", "type")
        .agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    )


@query
def scan_pages_of_heads(spark, sf_dir):
    found = parse.scan_signatures(inputs.page_lines(spark, sf_dir), dims.FINDING_CHARS)
    return found.groupBy("file_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def _page_events(spark: SparkSession, sf_dir: str, chars: int | None = None) -> DataFrame:
    found = parse.extract_events(inputs.page_lines(spark, sf_dir), chars)
    return found.groupBy("file_id", "entry_type").agg(F.count("*").alias("n"), F.sum(F.length("message")).alias("chars"))


@query
def page_events(spark, sf_dir):
    return _page_events(spark, sf_dir)


@query
def page_events_of_heads(spark, sf_dir):
    return _page_events(spark, sf_dir, dims.MESSAGE_CHARS)


@query
def extract_events(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "file_id", "line_no", "category_no", "entry_type", "message", "logged_on",
        _time("logged_ts").alias("logged_ts"),
    )


@query
def split_vulns(spark, sf_dir):
    vulns, others = parse.split_vulns(_events(spark, sf_dir))
    keep = ["file_id", "line_no", "vuln_type", "message"]
    return vulns.select(*keep).unionByName(
        others.withColumn("vuln_type", F.lit("-")).select(*keep)
    )


@query
def keep_error_warning(spark, sf_dir):
    return parse.keep_error_warning(_events(spark, sf_dir)).select("file_id", "line_no", "entry_type")


@query
def scan_summary(spark, sf_dir):
    return parse.scan_summary(inputs.log_lines(spark, sf_dir))


@query
def flat_findings(spark, sf_dir):
    names = inputs.load(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("file_id"), F.col("url").alias("name")
    )
    found = parse.flat_findings(parse.scan_signatures(inputs.page_lines(spark, sf_dir)), names)
    return found.groupBy("name", "type").agg(F.count("*").alias("n"))


@query
def capped_report(spark, sf_dir):
    return runs.scan_report(inputs.log_lines(spark, sf_dir))


@query
def scan_exclusions(spark, sf_dir):
    files = inputs.files(spark, sf_dir, with_text=False)
    return parse.scan_exclusions(files).select(
        "file_id", parse.excluded_by_substring(F.col("path")).alias("excluded_by_substring")
    )


@query
def security_scan(spark, sf_dir):
    """The whole scan over the landing texts, per file and type."""
    lines = readers.lines_of_texts(inputs.files(spark, sf_dir), "file_id", "path")
    found = runs.security_scan(lines, api=True)
    return found.groupBy("file_id", "type").agg(F.count("*").alias("n"))


# --- resolution ------------------------------------------------------------------------


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.keep_error_warning(_events(spark, sf_dir))


@query
def dedupe_incidents(spark, sf_dir):
    """Over document lines that repeat, so that there are copies to drop."""
    return _deduped(spark, sf_dir)


def _deduped(spark: SparkSession, sf_dir: str, chars: int | None = None) -> DataFrame:
    lines = inputs.doc_lines(spark, sf_dir).withColumn("line", F.concat(F.lit("Error: "), "line"))
    events = parse.keep_error_warning(parse.extract_events(lines))
    return enrich.dedupe_incidents(events, chars).select("file_id", "line_no", "entry_type", "message")


@query
def dedupe_incidents_of_heads(spark, sf_dir):
    return _deduped(spark, sf_dir, dims.DEDUPE_CHARS)


@query
def incident_signature_of_heads(spark, sf_dir):
    return enrich.with_signature(_events(spark, sf_dir), dims.SIGNATURE_CHARS).select("file_id", "line_no", "signature")


@query
def incident_signature(spark, sf_dir):
    return enrich.with_signature(_events(spark, sf_dir)).select("file_id", "line_no", "signature")


@query
def cached_resolution(spark, sf_dir):
    found = enrich.cached_resolution(
        enrich.with_signature(_events(spark, sf_dir)), inputs.resolution_cache(spark, sf_dir)
    )
    return found.select(
        "file_id", "line_no", "signature",
        F.coalesce("severity", F.lit("-")).alias("severity"),
        F.coalesce("solution", F.lit("-")).alias("solution"),
    )


@query
def fallback_vuln_resolution(spark, sf_dir):
    answers = inputs.model_answers(spark, sf_dir).select("signature", "vuln_type")
    return enrich.fallback_vuln_resolution(answers)


@query
def fallback_incident_resolution(spark, sf_dir):
    return enrich.fallback_incident_resolution(_incidents(spark, sf_dir)).select(
        "file_id", "line_no", "severity", "summary", "solution", "reference_url"
    )


@query
def fallback_incident_strict(spark, sf_dir):
    return enrich.fallback_incident_resolution(_incidents(spark, sf_dir), strict_warn=True).select(
        "file_id", "line_no", "entry_type", "severity"
    )


@query
def cache_upsert(spark, sf_dir):
    new = enrich.fallback_incident_resolution(
        enrich.with_signature(_incidents(spark, sf_dir))
    ).select("signature", *enrich.RESOLUTION)
    return enrich.cache_upsert(inputs.resolution_cache(spark, sf_dir), new)


@query
def parse_resolution_json(spark, sf_dir):
    return enrich.parse_resolution_json(inputs.model_answers(spark, sf_dir))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return runs.resolved_incidents(
        inputs.log_lines(spark, sf_dir), inputs.resolution_cache(spark, sf_dir)
    )


@query
def resolve_incidents(spark, sf_dir):
    events, vulns = _resolved(spark, sf_dir)
    keep = ["file_id", "line_no", "category_no", "entry_type", "signature", *enrich.RESOLUTION]
    return events.select(*keep).unionByName(vulns.select(*keep))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = enrich.resolution_requests(_events(spark, sf_dir), inputs.resolution_cache(spark, sf_dir))
    return enrich.parse_resolution_json(inputs.request_answers(requests))


@query
def resolve_with_answers(spark, sf_dir):
    """Requests, their answers, then the whole chain: cache, answer, fixed text."""
    lines, cache = inputs.log_lines(spark, sf_dir), inputs.resolution_cache(spark, sf_dir)
    events, vulns = runs.resolved_incidents(lines, cache, _answers(spark, sf_dir))
    keep = ["file_id", "line_no", "category_no", "entry_type", "signature", *enrich.RESOLUTION]
    return events.select(*keep).unionByName(vulns.select(*keep))


@query
def answers_to_cache(spark, sf_dir):
    """The cache after the answers are written back to it."""
    answers = materialize(_answers(spark, sf_dir).select("signature", *enrich.RESOLUTION), "answers")
    return enrich.cache_upsert(inputs.resolution_cache(spark, sf_dir), answers)


@query
def events_of_file(spark, sf_dir):
    """E10 and E11 of one file."""
    events, vulns = _resolved(spark, sf_dir)
    first = events.agg(F.min("file_id")).first()[0]
    listed = enrich.list_events(enrich.unified_events(events, vulns).withColumn("created_on", F.col("logged_on")), file_id=first)
    attacks = enrich.list_vulns(vulns.withColumn("analyzed_on", F.col("logged_on")), file_id=first)
    row = ["file_id", "line_no", "category_no", "entry_type"]
    return listed.select(F.lit("event").alias("kind"), *row).unionByName(attacks.select(F.lit("vulnerability").alias("kind"), *row))


@query
def unified_events(spark, sf_dir):
    return enrich.unified_events(*_resolved(spark, sf_dir)).drop("logged_ts")


@query
def list_events(spark, sf_dir):
    events = enrich.unified_events(*_resolved(spark, sf_dir)).withColumn("created_on", F.col("logged_on"))
    return enrich.list_events(events, entry_type="ERROR", limit=dims.LISTING_ROWS).select(
        "file_id", "line_no", "entry_type", "priority", "message", "created_on"
    )


@query
def list_vulns(spark, sf_dir):
    _, vulns = _resolved(spark, sf_dir)
    return enrich.list_vulns(
        vulns.withColumn("analyzed_on", F.col("logged_on")), severity="High", limit=dims.LISTING_ROWS
    ).select("file_id", "line_no", "vuln_type", "severity", "solution", "analyzed_on")


@query
def resolution_requests(spark, sf_dir):
    return enrich.resolution_requests(_events(spark, sf_dir), inputs.resolution_cache(spark, sf_dir))


# --- texts, keywords, categories -----------------------------------------------------------


@query
def clean_line(spark, sf_dir):
    return textfeat.clean_lines(inputs.doc_lines(spark, sf_dir)).select(
        "file_id", "line_no", F.md5("cleaned").alias("cleaned_md5")
    )


@query
def line_table(spark, sf_dir):
    return textfeat.line_table(inputs.doc_lines(spark, sf_dir)).select(
        "file_id", "line_no", F.md5("line").alias("line_md5")
    )


@query
def table_line_table(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return textfeat.table_line_table(inputs.order_tables(spark, sf_dir), columns, "o_orderkey")


@query
def table_line_table_of_first_rows(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return textfeat.table_line_table(inputs.order_tables(spark, sf_dir), columns, "o_orderkey", dims.TABLE_ROWS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select("doc_id", "text")


@query
def term_counts(spark, sf_dir):
    return textfeat.term_counts(_docs(spark, sf_dir))


@query
def tfidf(spark, sf_dir):
    weights = textfeat.tfidf(inputs.doc_line_rows(spark, sf_dir))
    return weights.select("row_id", "term", F.round("weight", 6).alias("weight"))


@query
def keyword_candidates(spark, sf_dir):
    return textfeat.keyword_candidates(_docs(spark, sf_dir), dims.MAX_TERMS, dims.HEAD_CHARS)


@query
def mmr_keywords(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    candidates = textfeat.keyword_candidates(docs, dims.MAX_TERMS).where(~F.col("fallback"))
    return textfeat.mmr_keywords(
        retrieval.embed_column(candidates, "term"), retrieval.embed_column(docs, "text")
    )


@query
def doc_sample(spark, sf_dir):
    """With a small size, so that long documents are in fact cut."""
    return textfeat.doc_sample(_docs(spark, sf_dir), chars=1500).select(
        "doc_id", F.length("sample").alias("chars"), F.md5("sample").alias("sample_md5")
    )


@query
def file_summary(spark, sf_dir):
    return runs.summaries_by_weight(_docs(spark, sf_dir), dims.HEAD_CHARS)


@query
def category_by_domain(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "file_id", textfeat.category_by_domain(F.col("text")).alias("category")
    )


@query
def category_dynamic(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "file_id",
        textfeat.category_dynamic(F.concat(F.lit("Total Entries: 3. Keywords: log, "), "text")).alias("category"),
    )


# --- clusters ------------------------------------------------------------------------------


def _clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written: they are read by each step of the clustering, and cleaning is most of its work."""
    rows = inputs.log_rows(spark, sf_dir).select("row_id", "file_id", "line_no", "line")
    return materialize(textfeat.clean_lines(textfeat.line_table(rows)), "clean-rows")


def _top_terms(rows: DataFrame, labels: DataFrame) -> DataFrame:
    weights = textfeat.tfidf(rows.select("row_id", F.col("cleaned").alias("text")))
    return cluster.cluster_top_terms(weights, labels)


@query
def template_clusters(spark, sf_dir):
    return cluster.template_clusters(_clean_rows(spark, sf_dir)).select("row_id", "cluster_id")


@query
def density_clusters_lines(spark, sf_dir):
    rows = inputs.doc_line_rows(spark, sf_dir)
    return cluster.density_clusters_lines(rows, LINE_EPS)


@query
def density_clusters_files(spark, sf_dir):
    vectors = inputs.vectors(spark, sf_dir).select(F.col("id").alias("row_id"), "embedding")
    return cluster.density_clusters_vectors(vectors, VECTOR_EPS)


def _template_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _clean_rows(spark, sf_dir)
    return rows, materialize(cluster.template_clusters(rows).drop("cleaned"), "template-labels")


@query
def cluster_top_terms(spark, sf_dir):
    return _top_terms(*_template_labels(spark, sf_dir))


@query
def cluster_label(spark, sf_dir):
    rows, labels = _template_labels(spark, sf_dir)
    return cluster.cluster_label(labels, _top_terms(rows, labels))


@query
def majority_category(spark, sf_dir):
    return cluster.majority_category(_clustered(spark, sf_dir))


@query
def large_run(spark, sf_dir):
    files = inputs.files(spark, sf_dir)
    docs = files.select(
        F.substring_index("file_id", "-", -1).cast("long").alias("doc_id"), "name", "text"
    )
    return runs.large_run(docs, chars=dims.HEAD_CHARS)


@query
def small_run(spark, sf_dir):
    return runs.small_run(inputs.log_rows(spark, sf_dir).select("row_id", "file_id", "line"))


# --- reports -------------------------------------------------------------------------------


@query
def line_duplicates(spark, sf_dir):
    return tools.line_duplicates(inputs.doc_lines(spark, sf_dir))


@query
def top_recurring_lines(spark, sf_dir):
    return tools.top_recurring_lines(inputs.doc_lines(spark, sf_dir))


_ITEM = ["l_quantity", "l_discount", "l_returnflag"]


@query
def row_duplicates(spark, sf_dir):
    return tools.row_duplicates(inputs.load(spark, sf_dir, "lineitem").select(*_ITEM))


@query
def top_row_values(spark, sf_dir):
    return tools.top_row_values(inputs.load(spark, sf_dir, "lineitem").select(*_ITEM))


@query
def timeline_text(spark, sf_dir):
    return tools.timeline_text(inputs.mixed_lines(spark, sf_dir), inputs.YEAR).select(
        "file_id", _time("start_ts").alias("start_ts"), _time("end_ts").alias("end_ts"),
        "duration_seconds", "events",
    )


@query
def timeline_table(spark, sf_dir):
    return tools.timeline_table(inputs.load(spark, sf_dir, "orders")).select(
        "time_column", _time("start_ts").alias("start_ts"), _time("end_ts").alias("end_ts"), "entries"
    )


@query
def peak_hour(spark, sf_dir):
    return tools.peak_hour(inputs.mixed_lines(spark, sf_dir), inputs.YEAR)


@query
def hourly_histogram(spark, sf_dir):
    return tools.hourly_histogram(inputs.mixed_lines(spark, sf_dir), inputs.YEAR)


@query
def extract_patterns(spark, sf_dir):
    return tools.extract_patterns(inputs.doc_lines(spark, sf_dir))


@query
def extract_patterns_logs(spark, sf_dir):
    return tools.extract_patterns(inputs.log_lines(spark, sf_dir))


@query
def extract_http_errors(spark, sf_dir):
    return tools.extract_http_errors(inputs.doc_lines(spark, sf_dir))


# --- retrieval ------------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunk_text(inputs.files(spark, sf_dir))


@query
def chunk_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select(
        "file_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("text_md5")
    )


@query
def chunk_lines(spark, sf_dir):
    """The same pieces from lines, without a whole file in a row."""
    found = retrieval.chunk_lines(inputs.doc_lines(spark, sf_dir), block_lines=16)
    return found.select("file_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query
def sample_lines(spark, sf_dir):
    found = retrieval.sample_lines(inputs.doc_lines(spark, sf_dir), 1500, block_lines=16)
    return found.select("file_id", F.length("text").alias("chars"), F.md5("text").alias("sample_md5"))


@query
def index_docs(spark, sf_dir):
    events, vulns = _resolved(spark, sf_dir)
    summaries = inputs.files(spark, sf_dir, with_text=False).select("file_id", F.col("path").alias("summary"))
    docs = retrieval.index_docs(
        summaries,
        _chunks(spark, sf_dir),
        enrich.unified_events(events, vulns),
        vulns,
        inputs.file_master(spark, sf_dir),
    )
    filled = [F.coalesce(c, F.lit("-")).alias(c) for c in retrieval.DOC_FIELDS if c != "text"]
    return docs.select(*filled, F.md5("text").alias("text_md5"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    first = inputs.load(spark, sf_dir, "documents").select(
        F.lit("chunks").alias("collection"), F.concat(F.lit("doc-"), "doc_id").alias("id"),
        F.col("source").alias("text"), F.lit(1).alias("version"),
    )
    second = inputs.load(spark, sf_dir, "labels").select(
        F.lit("chunks").alias("collection"), F.concat(F.lit("doc-"), "doc_id").alias("id"),
        F.concat(F.lit("quality "), "quality").alias("text"), F.lit(2).alias("version"),
    )
    return first, second


@query
def upsert_docs(spark, sf_dir):
    return retrieval.upsert_docs(*_versions(spark, sf_dir))


@query
def topk_similar(spark, sf_dir):
    return retrieval.topk_similar(inputs.vectors(spark, sf_dir), inputs.questions(spark, sf_dir))


@query
def topk_similar_l2(spark, sf_dir):
    return retrieval.topk_similar(
        inputs.vectors(spark, sf_dir), inputs.questions(spark, sf_dir), k=10, metric="l2"
    )


@query
def topk_similar_where(spark, sf_dir):
    return retrieval.topk_similar(
        inputs.vectors(spark, sf_dir), inputs.questions(spark, sf_dir), where={"label": 3}
    )


@query
def topk_similar_lsh(spark, sf_dir):
    """With the share of the exact neighbours found."""
    vectors, questions = inputs.vectors(spark, sf_dir), inputs.questions(spark, sf_dir)
    exact = retrieval.topk_similar(vectors, questions, metric="l2")
    return retrieval.with_recall(retrieval.topk_similar_lsh(vectors, questions), exact)


def _search_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = inputs.load(spark, sf_dir, "documents")
    both = inputs.vectors(spark, sf_dir).join(texts, F.col("id") == F.col("doc_id")).select(
        "id", F.concat(F.lit("doc-"), "doc_id").alias("file_id"), "embedding", "text", "source", "lang"
    )
    summaries = both.select("id", "file_id", "embedding", F.concat_ws(" ", "source", "lang").alias("text"))
    return summaries, both.select("id", "file_id", "embedding", "text")


@query
def retrieval_context(spark, sf_dir):
    found = retrieval.retrieval_context(*_search_texts(spark, sf_dir), inputs.questions(spark, sf_dir))
    return found.select("query_id", F.md5("context").alias("context_md5"))


@query
def search_report(spark, sf_dir):
    summaries, _ = _search_texts(spark, sf_dir)
    return retrieval.search_report(summaries, inputs.questions(spark, sf_dir), "Summary")


@query
def embed_column(spark, sf_dir):
    made = retrieval.embed_column(_docs(spark, sf_dir))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").alias("dim"), F.round(F.sqrt(square), 4).alias("length"))


@query
def collection_stats(spark, sf_dir):
    events, vulns = _resolved(spark, sf_dir)
    return retrieval.collection_stats(
        retrieval.index_docs(
            chunks=_chunks(spark, sf_dir), events=enrich.unified_events(events, vulns), vulns=vulns,
            master=inputs.file_master(spark, sf_dir),
        )
    )


@query
def collection_head(spark, sf_dir):
    docs = retrieval.index_docs(chunks=_chunks(spark, sf_dir))
    return retrieval.collection_head(docs, "chunks").select("id", "file_id")


# --- stream -----------------------------------------------------------------------------------


@query
def stream_events(spark, sf_dir):
    out = scratch_path(spark, "stream-out")
    streams.stream_events(
        streams.log_stream(spark, _written_logs(spark, sf_dir) + "/*"), out, scratch_path(spark, "stream-state")
    ).awaitTermination()
    return (
        spark.read.parquet(out).groupBy("entry_type", "vuln_type").agg(F.count("*").alias("n"))
        .select("entry_type", F.coalesce("vuln_type", F.lit("-")).alias("vuln_type"), "n")
    )


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files that a stream picks up."""
    path = scratch_path(spark, "event-files")
    events = _events(spark, sf_dir)
    events.write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


@query
def stream_dedupe(spark, sf_dir):
    out = scratch_path(spark, "stream-out")
    kept = streams.stream_dedupe(_event_stream(spark, sf_dir))
    streams.append_rows(kept, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("file_id", "entry_type").agg(F.count("*").alias("n"))


@query
def stream_hourly(spark, sf_dir):
    out = scratch_path(spark, "stream-out")
    counts = streams.stream_hourly(_event_stream(spark, sf_dir))
    streams.write_updates(counts, out, scratch_path(spark, "stream-state")).awaitTermination()
    return streams.hourly_totals(spark, out).select("file_id", _time("hour_start").alias("hour_start"), "events")


@query
def incident_totals(spark, sf_dir):
    """The flagship: lines to resolved incidents, counted by type and severity."""
    events, vulns = _resolved(spark, sf_dir)
    return (
        enrich.unified_events(events, vulns)
        .groupBy("entry_type", "severity")
        .agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))
    )
