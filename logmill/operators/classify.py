"""File classification and routing over ``files(file_id, name, text, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logmill.functions import dims
from logmill.functions.expr import best_of, contains_any, extension, head, hits


def _confident(category: Column, confidence: Column) -> Column:
    return F.struct(category.alias("category"), confidence.alias("confidence"))


def log_fast_path(name: Column, text: Column, chars: int | None = None) -> Column:
    """("log", 1.0) for .log/.txt files that show a level word, anywhere or in
    their first ``chars``."""
    seen = F.upper(head(text, chars))
    ends = F.lower(name).endswith(".log") | F.lower(name).endswith(".txt")
    return F.when(
        ends & contains_any(seen, dims.FAST_PATH_WORDS), _confident(F.lit("log"), F.lit(1.0))
    )


def keyword_file_class(
    files: DataFrame, unless: Column | None = None, chars: int | None = None
) -> DataFrame:
    """Adds ``_class`` (category, confidence): the best keyword score of four
    classes over the text, or its first ``chars``; else the extension's default.

    The scores become columns before they are compared, so each keyword is
    looked for once. Rows where ``unless`` holds are not searched.
    """
    seen = F.lower(head(F.coalesce(F.col("text"), F.lit("")), chars))
    if unless is not None:
        seen = F.when(~unless, seen)
    scores = {c: hits(F.col("_head"), words) for c, words in dims.CLASS_KEYWORDS.items()}
    best = F.col("_best")
    plain = extension(F.col("name")).isin("log", "txt")
    found = F.when(
        best["score"] > 0,
        _confident(best["name"], F.least(best["score"] / F.lit(10.0), F.lit(0.9))),
    ).otherwise(
        F.when(plain, _confident(F.lit("log"), F.lit(0.6))).otherwise(
            _confident(F.lit("other_document"), F.lit(0.5))
        )
    )
    return (
        files.withColumn("_head", seen)
        .withColumn("_best", best_of(scores))
        .withColumn("_class", found)
        .drop("_head", "_best")
    )


def normalize_label(label: Column) -> Column:
    """C4: a classifier's label to a folder name."""
    low = F.lower(label)
    return (
        F.when(low.contains("log"), F.lit("log"))
        .when(low.contains("curriculum vitae"), F.lit("cv"))
        .when(low.contains("resume"), F.lit("resume"))
        .when(low.contains("invoice"), F.lit("invoice"))
        .when(low.contains("report"), F.lit("report"))
        .when(low.contains("contract") | low.contains("agreement"), F.lit("contract"))
        .otherwise(F.lower(F.replace(label, F.lit(" "), F.lit("_"))))
    )


def classify_files(
    files: DataFrame, fast_chars: int | None = None, chars: int | None = None
) -> DataFrame:
    """Fast path, else a supplied label, else the keyword class.

    Optional columns ``label`` and ``score`` hold a model's answer.
    """
    given = F.lit(None).cast("struct<category:string,confidence:double>")
    if "label" in files.columns:
        given = F.when(
            F.col("label").isNotNull(),
            _confident(normalize_label(F.col("label")), F.col("score").cast("double")),
        )
    known = files.withColumn(
        "_known", F.coalesce(log_fast_path(F.col("name"), F.col("text"), fast_chars), given)
    )
    return (
        keyword_file_class(known, unless=F.col("_known").isNotNull(), chars=chars)
        .withColumn("_c", F.coalesce("_known", "_class"))
        .select(*files.columns, "_c.*")
    )


def log_like_tables(table_columns: DataFrame) -> DataFrame:
    """``table_columns(file_id, column_name)`` to (file_id, is_log_table)."""
    hit = contains_any(F.lower("column_name"), dims.LOG_COLUMN_WORDS)
    return table_columns.groupBy("file_id").agg(F.bool_or(hit).alias("is_log_table"))


def has_log_columns(columns: list[str]) -> bool:
    """C5 for the columns of one table."""
    return any(word in c.lower() for c in columns for word in dims.LOG_COLUMN_WORDS)


def low_confidence_recheck(category: Column, confidence: Column, text: Column) -> Column:
    """An unsure "log" without any log word becomes other_document."""
    return F.when(
        (category == "log")
        & (confidence < 0.6)
        & ~contains_any(F.lower(text), dims.LOG_EVIDENCE),
        F.lit("other_document"),
    ).otherwise(category)


def ingest_status(name: Column, readable: Column | None = None) -> Column:
    """Structured, text, unsupported or error."""
    ext = extension(name)
    kind = (
        F.when(ext.isin(*dims.STRUCTURED_EXTENSIONS), F.lit("structured"))
        .when(ext.isin(*dims.TEXT_EXTENSIONS), F.lit("text"))
        .otherwise(F.lit("unsupported"))
    )
    if readable is None:
        return kind
    return F.when((kind != "unsupported") & ~readable, F.lit("error")).otherwise(kind)


def final_file_type(
    files: DataFrame, table_columns: DataFrame | None = None, classifier: bool = True
) -> DataFrame:
    """The file type that routing uses.

    Tables with log-like columns are logs; other files take their class; an
    unsure log is checked again. Without a classifier, tables stay
    structured_data and everything else is a log.
    """
    status = ingest_status(F.col("name"))
    if not classifier:
        return files.withColumn("ingest_status", status).withColumn(
            "file_type",
            F.when(F.col("ingest_status") == "unsupported", F.lit("unsupported"))
            .when(F.col("ingest_status") == "structured", F.lit("structured_data"))
            .otherwise(F.lit("log")),
        )
    out = classify_files(files).withColumn("ingest_status", status)
    is_table = F.lit(False)
    if table_columns is not None:
        out = out.join(log_like_tables(table_columns), "file_id", "left")
        is_table = (F.col("ingest_status") == "structured") & F.coalesce("is_log_table", F.lit(False))
    kind = F.when(is_table, F.lit("log")).otherwise(F.col("category"))
    # An empty text is never classified: tables keep their kind, texts are logs.
    kind = F.when(
        F.coalesce(F.col("text"), F.lit("")) == "",
        F.when(F.col("ingest_status") == "structured", F.lit("structured_data")).otherwise(F.lit("log")),
    ).otherwise(low_confidence_recheck(kind, F.col("confidence"), F.col("text")))
    return out.withColumn(
        "file_type",
        F.when(F.col("ingest_status") == "unsupported", F.lit("unsupported")).otherwise(kind),
    ).select(*files.columns, "ingest_status", "confidence", "file_type")


def route_files(typed: DataFrame) -> DataFrame:
    """Destination folder and whether the file goes on to analysis."""
    own = dims.ROUTED_DOCUMENT_TYPES + ["structured_data"]
    kind = F.col("file_type")
    return typed.withColumns(
        {
            "destination": F.when(kind.isin(*own), kind)
            .when(kind.isin("unsupported", "error"), F.lit(None).cast("string"))
            .otherwise(F.lit("staging")),
            "goes_to_analysis": ~kind.isin(*own, "unsupported", "error"),
        }
    )


def table_sample_text(
    rows: DataFrame, columns: list[str], order: str, n: int = 10, header: bool = True
) -> DataFrame:
    """Per table the first ``n`` rows as text, under its column names.

    Only ``n`` rows per file leave the window (group limit before the shuffle).
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in columns]
    first = (
        rows.select("file_id", F.col(order).alias("_o"), F.concat_ws(" ", *cells).alias("_row"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy("file_id").orderBy("_o")))
        .where(F.col("_rn") <= n)
    )
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", "_row"))), lambda r: r["_row"]
        ),
        "\n",
    )
    top = f"Table Columns: {', '.join(columns)}\nData Sample:\n" if header else ""
    return first.groupBy("file_id").agg(F.concat(F.lit(top), body).alias("sample"))
