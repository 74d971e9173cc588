"""Resolution of incidents: signatures, cache, supplied answers, fixed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions import dims
from logmill.functions.expr import head
from logmill.operators.metadata import first_per_key, first_rows, insert_if_absent

RESOLUTION = ["severity", "summary", "solution", "reference_url"]


def dedupe_incidents(events: DataFrame, chars: int | None = None) -> DataFrame:
    """Per file the first event of each type and message, or of each type and
    first ``chars`` of the message.

    A plain grouping with a minimum: copies collapse before the shuffle, so a
    message that fills a third of a file costs one row per task.
    """
    rest = [c for c in events.columns if c not in ("file_id", "entry_type", "line_no", "category_no")]
    return (
        events.groupBy(
            "file_id", "entry_type", head(F.col("message"), chars).alias("_head")
        )
        .agg(F.min(F.struct("line_no", "category_no", *rest)).alias("first"))
        .select("file_id", "entry_type", "first.*")
        .select(*events.columns)
    )


def incident_signature(chars: int | None = None) -> Column:
    """The cache key, of the whole message or its first ``chars``; attacks share
    one key per type."""
    return F.when(F.col("entry_type") == "Vulnerability", F.col("vuln_type")).otherwise(
        F.concat("entry_type", F.lit(":"), head(F.col("message"), chars))
    )


def with_signature(events: DataFrame, chars: int | None = None) -> DataFrame:
    return events.withColumn("signature", incident_signature(chars))


def _resolution_struct(values: tuple[str, str, str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(RESOLUTION, values)])


def fixed_resolution(vuln_type: Column) -> Column:
    """E4 as one struct column: five known types, else the default text."""
    known = F.create_map(
        *[
            part
            for name, values in dims.FIXED_RESOLUTIONS.items()
            for part in (F.lit(name), _resolution_struct(values))
        ]
    )
    return F.coalesce(F.try_element_at(known, vuln_type), _resolution_struct(dims.DEFAULT_RESOLUTION))


def incident_resolution(entry_type: Column, message: Column, strict_warn: bool = False) -> Column:
    """E5 as one struct column. Warnings get Medium; with ``strict_warn`` only
    the spelling "WARN" does."""
    mild = [F.lit("WARN")] if strict_warn else [F.lit("WARN"), F.lit("WARNING")]
    query = F.replace(F.substring(message, 1, dims.SIGNATURE_CHARS), F.lit(" "), F.lit("+"))
    return F.struct(
        F.when(entry_type.isin(*mild), F.lit("Medium")).otherwise(F.lit("High")).alias("severity"),
        F.lit("").alias("summary"),
        F.concat(F.lit("Investigate the "), entry_type, F.lit(" log: "), message).alias("solution"),
        F.concat(F.lit(dims.SEARCH_URL), query).alias("reference_url"),
    )


def fallback_vuln_resolution(vulns: DataFrame) -> DataFrame:
    """E4 on a table with ``vuln_type``."""
    return _put(vulns, fixed_resolution(F.col("vuln_type")))


def fallback_incident_resolution(events: DataFrame, strict_warn: bool = False) -> DataFrame:
    """E5 on a table with ``entry_type`` and ``message``."""
    return _put(events, incident_resolution(F.col("entry_type"), F.col("message"), strict_warn))


def _put(df: DataFrame, resolution: Column) -> DataFrame:
    return df.withColumn("_r", resolution).select(*df.columns, "_r.*")


def cached_resolution(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Look up each signature; unresolved rows keep nulls.

    ``cache(signature, severity, summary, solution, reference_url)`` is unique
    by signature. It grows with the data, so no broadcast is forced: the
    planner broadcasts it by its size or joins by shuffle with skew splitting.
    """
    return events.join(cache.select("signature", *RESOLUTION), "signature", "left")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache plus the new signatures; stored ones stay."""
    return insert_if_absent(cache, new, "signature")


def parse_resolution_json(answers: DataFrame) -> DataFrame:
    """``answers(signature, vuln_type, response)`` to resolution columns.

    The text from the first ``{`` to the last ``}`` is read as JSON; a list of
    steps is joined by blanks; a CVE id goes in front; what cannot be read gets
    the fixed resolution of its type. No response at all is a failed call: an
    incident (no ``vuln_type``) then asks for a manual investigation.
    """
    body = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    doc = F.try_parse_json(body)
    fixed = fixed_resolution(F.col("vuln_type"))

    def text(field: str) -> Column:
        return F.try_variant_get(F.col("doc"), f"$.{field}", "string")

    steps = F.try_variant_get(F.col("doc"), "$.solution", "array<string>")
    solution = F.coalesce(
        F.array_join(steps, " "), text("solution"), F.lit(dims.ANSWER_DEFAULT_SOLUTION)
    )
    cve = text("cve_id")
    read = F.struct(
        F.coalesce(text("severity"), F.lit("Medium")).alias("severity"),
        F.coalesce(text("summary"), F.lit(dims.DEFAULT_RESOLUTION[1])).alias("summary"),
        F.when(cve.startswith("CVE-"), F.concat(F.lit("[CVE: "), cve, F.lit("] "), solution))
        .otherwise(solution)
        .alias("solution"),
        F.coalesce(text("reference_url"), fixed["reference_url"]).alias("reference_url"),
    )
    failed = F.col("response").isNull() & F.col("vuln_type").isNull()
    by_hand = _resolution_struct(dims.FAILED_CALL_RESOLUTION)
    return (
        answers.withColumn("doc", doc)
        .withColumn("_r", F.when(failed, by_hand).when(F.col("doc").isNull(), fixed).otherwise(read))
        .select("signature", "vuln_type", "_r.*")
    )


def resolve_incidents(
    events: DataFrame,
    cache: DataFrame,
    answers: DataFrame | None = None,
    strict_warn: bool = False,
) -> DataFrame:
    """Cache, then supplied answers, then the fixed texts.

    ``answers`` has the layout of E7's result; of several for one signature one
    is taken. Level events are expected deduped (E1).
    """
    out = cached_resolution(with_signature(events), cache)
    found = F.when(F.col("severity").isNotNull(), F.struct(*RESOLUTION))
    choices = [found]
    if answers is not None:
        given = first_per_key(answers.select("signature", *RESOLUTION), "signature", RESOLUTION)
        out = out.join(
            given.select("signature", F.struct(*RESOLUTION).alias("_answer")), "signature", "left"
        )
        choices.append(F.col("_answer"))
    choices.append(
        F.when(
            F.col("entry_type") == "Vulnerability", fixed_resolution(F.col("vuln_type"))
        ).otherwise(incident_resolution(F.col("entry_type"), F.col("message"), strict_warn))
    )
    return out.withColumn("_r", F.coalesce(*choices)).select(*events.columns, "signature", "_r.*")


def resolve_vulns(
    vulns: DataFrame, cache: DataFrame, answers: DataFrame | None = None
) -> DataFrame:
    """E8 for the scanner's vulnerabilities. Their signatures are the five known
    types, so after grouping at most five rows of a table can match: those are
    broadcast, and a type that fills a third of all rows skews nothing."""

    def few(table: DataFrame) -> DataFrame:
        known = table.where(F.col("signature").isin(list(dims.FIXED_RESOLUTIONS)))
        return F.broadcast(first_per_key(known.select("signature", *RESOLUTION), "signature", RESOLUTION))

    return resolve_incidents(vulns, few(cache), None if answers is None else few(answers))


def unified_events(resolved_events: DataFrame, resolved_vulns: DataFrame) -> DataFrame:
    """One layout for both kinds (columns of the event table)."""

    def layout(df: DataFrame) -> DataFrame:
        return df.select(
            "file_id", "line_no", "category_no", "entry_type", "message", "severity",
            F.col("solution").alias("resolution"), F.col("summary").alias("resolution_summary"),
            "reference_url", "logged_on", "logged_ts",
        )

    return layout(resolved_events).unionByName(layout(resolved_vulns))


def list_events(
    events: DataFrame, file_id: str | None = None, entry_type: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest first, with Priority = severity: all, or the first ``limit``."""
    if file_id is not None:
        events = events.where(F.col("file_id") == file_id)
    if entry_type is not None:
        events = events.where(F.col("entry_type") == entry_type)
    marked = events.withColumn("priority", F.coalesce("severity", F.lit("Medium")))
    return first_rows(marked.orderBy(F.col("created_on").desc(), "file_id", "line_no", "category_no"), limit)


def list_vulns(
    vulns: DataFrame,
    file_id: str | None = None,
    vuln_type: str | None = None,
    severity: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Newest analysis first: all, or the first ``limit``."""
    for name, value in (("file_id", file_id), ("vuln_type", vuln_type), ("severity", severity)):
        if value is not None:
            vulns = vulns.where(F.col(name) == value)
    return first_rows(vulns.orderBy(F.col("analyzed_on").desc(), "file_id", "line_no", "category_no"), limit)


def resolution_requests(events: DataFrame, cache: DataFrame) -> DataFrame:
    """One request per signature the cache does not know, with its prompt.

    Signatures are made distinct before the anti join, so the join sees each
    once whatever the skew of the events.
    """
    distinct = with_signature(events).groupBy("signature").agg(
        F.min(F.struct("file_id", "line_no", "entry_type", "vuln_type", "message")).alias("first")
    )
    todo = distinct.join(cache.select("signature"), "signature", "left_anti").select(
        "signature", "first.entry_type", "first.vuln_type", "first.message"
    )
    is_attack = F.col("entry_type") == "Vulnerability"
    task = F.when(
        is_attack,
        F.concat(F.lit("Analyze this vulnerability. Vulnerability Type: "), "vuln_type"),
    ).otherwise(F.concat(F.lit("Analyze this log incident. Log Level: "), "entry_type"))
    ask = (
        "\nAnswer as JSON with the keys severity (High, Medium or Low), summary, solution, "
        "reference_url and cve_id (empty when none applies)."
    )
    return todo.select(
        "signature",
        "entry_type",
        "vuln_type",
        F.concat(task, F.lit("\nLog Message: "), "message", F.lit(ask)).alias("prompt"),
    )
