"""The audit table of files: profile, insert, update, delete, rename chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions import dims
from logmill.session import materialize, round_tables


def file_uuid(name: Column, at_start: bool = False) -> Column:
    """M7: the UUID in a name (at its start for routed files), or null."""
    pattern = ("^" if at_start else "") + f"({dims.UUID_PATTERN})"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def file_ids(files: DataFrame) -> DataFrame:
    """M7: ids per file: for metadata (UUID anywhere, else a hash of the path)
    and for events (UUID at the start, else the name)."""
    return files.select(
        "name",
        F.coalesce(
            file_uuid(F.col("name")),
            F.concat(F.lit("AUDIT-"), F.substring(F.sha2("path", 256), 1, 16)),
        ).alias("file_id"),
        F.coalesce(file_uuid(F.col("name"), at_start=True), F.col("name")).alias("event_file_id"),
    )


def profile_files(files: DataFrame, lines: DataFrame, strict: bool = False) -> DataFrame:
    """M1: audit rows for ``files(file_id, name, stored_name, path, size_bytes, staged)``.

    Row counts come from ``lines``. A document routed elsewhere is "Routed";
    with ``strict`` it is "Failed", and names with "API" are taken first.
    """
    counts = lines.groupBy("file_id").agg(F.count("*").alias("row_count"))
    is_api = F.col("name").contains("API")
    staged = F.col("staged")
    status = (
        F.when(staged | is_api, F.lit("Success"))
        .otherwise(F.lit("Failed" if strict else "Routed"))
    )
    # A file fetched from an interface, or not staged, has no stored copy.
    stored = staged & ~is_api
    return files.join(counts, "file_id", "left").select(
        "file_id",
        F.col("name").alias("original_filename"),
        F.when(stored, F.col("stored_name")).otherwise(F.lit("N/A")).alias("stored_filename"),
        F.when(is_api, F.lit("External API"))
        .when(staged & F.col("name").contains("Email"), F.lit("Email Attachment"))
        .otherwise(F.lit("Local Upload"))
        .alias("source_type"),
        F.when(stored, F.col("path")).otherwise(F.lit("N/A")).alias("raw_storage_path"),
        F.lit("Pending").alias("final_path"),
        F.lit("Pending").alias("category"),
        F.lit("N/A").alias("cluster_id"),
        F.lit("N/A").alias("summary"),
        F.when(stored, F.round(F.col("size_bytes") / 1024, 2)).otherwise(F.lit(0.0)).alias("file_size_kb"),
        F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
        status.alias("status"),
    )


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of the lowest ``order`` for each key, reduced before the shuffle."""
    order = [c for c in order if c != key]
    rest = [c for c in rows.columns if c != key and c not in order]
    if not order + rest:
        return rows.distinct()
    return (
        rows.groupBy(key)
        .agg(F.min(F.struct(*order, *rest)).alias("first"))
        .select(key, "first.*")
        .select(*rows.columns)
    )


def insert_if_absent(
    table: DataFrame, new: DataFrame, key: str, order: list[str] | None = None
) -> DataFrame:
    """M2: the table plus the new rows whose key it lacks; first new row wins."""
    order = order or [c for c in new.columns if c != key]
    fresh = first_per_key(new, key, order).join(table.select(key), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def update_by_name(master: DataFrame, updates: DataFrame) -> DataFrame:
    """M3: set the analysis columns where ``stored_filename`` matches.

    ``updates(stored_filename, category, final_path, cluster_id, summary,
    update_no)``: the highest ``update_no`` of a name wins, as repeated updates
    would leave it.
    """
    fields = ["category", "final_path", "cluster_id", "summary"]
    last = updates.groupBy("stored_filename").agg(
        F.max_by(F.struct(*fields), "update_no").alias("new")
    )
    # written, so that the join has its own exchange on both sides and can split hot names
    last = materialize(last, "updates")
    out = master.join(last, "stored_filename", "left")
    hit = F.col("new").isNotNull()
    changed = {f: F.when(hit, F.col(f"new.{f}")).otherwise(F.col(f)) for f in fields}
    changed["status"] = F.when(hit, F.lit("Processed")).otherwise(F.col("status"))
    return out.withColumns(changed).select(*master.columns)


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def list_files(
    master: DataFrame, file_id: str | None = None, status: str | None = None, limit: int | None = None
) -> DataFrame:
    """M4: newest first, five columns: all files, or the first ``limit`` (a distributed top-k)."""
    if file_id is not None:
        master = master.where(F.col("file_id") == file_id)
    if status is not None:
        master = master.where(F.col("status") == status)
    return (
        first_rows(master.orderBy(F.col("created_on").desc(), "file_id"), limit)
        .select("file_id", "original_filename", "category", "status", "created_on")
    )


def _path(df: DataFrame) -> DataFrame:
    final, raw = F.col("final_path"), F.col("raw_storage_path")
    return df.withColumn(
        "path",
        F.when(final != "Pending", final).when(raw != "N/A", raw),
    )


def chain_ends(master: DataFrame) -> DataFrame:
    """M5 for every row: the last row of its rename chain, as (id, end_id).

    A row points to the last later row whose original name is its stored name.
    Ids only grow along a chain, so there are no cycles, and pointer doubling
    reaches every end in log2(longest chain) rounds whatever its length.
    """
    last_of_name = master.groupBy(F.col("original_filename").alias("stored_filename")).agg(
        F.max("id").alias("next_id")
    )
    named = (F.col("stored_filename") != "N/A") & (
        F.col("stored_filename") != F.col("original_filename")
    )
    # Rows that point nowhere, most of them, stay out of the rounds.
    links = (
        master.where(named)
        .select("id", "stored_filename")
        .join(last_of_name, "stored_filename")
        .where(F.col("next_id") > F.col("id"))
        .select("id", F.col("next_id").alias("end_id"))
    )
    write = round_tables(master.sparkSession, "chain")
    links = write(links)
    while True:
        onward = links.select(F.col("id").alias("end_id"), F.col("end_id").alias("further"))
        links = write(
            links.join(onward, "end_id", "left").select(
                "id",
                F.coalesce("further", "end_id").alias("end_id"),
                F.col("further").isNotNull().alias("moved"),
            )
        )
        moved = links.where("moved").limit(1).count()
        links = links.select("id", "end_id")
        if not moved:
            break
    return (
        master.select("id")
        .join(links, "id", "left")
        .select("id", F.coalesce("end_id", "id").alias("end_id"))
    )


def resolve_paths(master: DataFrame) -> DataFrame:
    """M5 for every name on record: the path its newest row leads to."""
    start = master.groupBy("original_filename").agg(F.max("id").alias("id"))
    ends = start.join(chain_ends(master), "id").select("original_filename", "end_id")
    target = _path(master).select(F.col("id").alias("end_id"), "path")
    return ends.join(target, "end_id").select("original_filename", "end_id", "path")


def follow_names(master: DataFrame, starts: DataFrame) -> DataFrame:
    """M5 from given rows, ``starts(name, id)``: (name, end_id).

    A frontier search: each round joins only the rows reached so far with the names on
    record, and a chain that ends leaves the frontier. Ids grow along a chain, so no row
    is reached twice. One round for each rename; ``chain_ends`` is the form for all rows.
    """
    rows = master.select("id", "stored_filename", "original_filename")
    named = (F.col("stored_filename") != "N/A") & (F.col("stored_filename") != F.col("original_filename"))
    later = rows.select(F.col("original_filename").alias("stored_filename"), F.col("id").alias("next_id"))
    write = round_tables(master.sparkSession, "frontier")
    frontier, ends = write(starts.select("name", "id")), []
    while True:
        # written, so that the planner knows how few names meet those on record
        names = materialize(frontier.join(rows.where(named), "id").select("name", "id", "stored_filename"), "names")
        onward = (
            names.join(later, "stored_filename")
            .where(F.col("next_id") > F.col("id"))
            .groupBy("name").agg(F.max("next_id").alias("next_id"))
        )
        reached = materialize(frontier.join(onward, "name", "left"), "reached")
        ends.append(reached.where("next_id IS NULL").select("name", F.col("id").alias("end_id")))
        frontier = write(reached.where("next_id IS NOT NULL").select("name", F.col("next_id").alias("id")))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, ends)


def resolve_path(master: DataFrame, name: str) -> DataFrame:
    """M5 for one name: exact match, else the newest name that contains it."""
    low = F.lower(F.col("original_filename"))
    match = F.struct((F.col("original_filename") == name).alias("exact"), F.col("id").alias("id"))
    start = (
        master.where(low.contains(name.lower()))
        .agg(F.max(match).alias("m"))
        .where(F.col("m").isNotNull())
        .select(F.lit(name).alias("name"), F.col("m.id").alias("id"))
    )
    ends = follow_names(master, start)
    return ends.join(_path(master).select(F.col("id").alias("end_id"), "path"), "end_id").select(
        "name", "end_id", "path"
    )


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """M6: each table without the files of ``doomed(file_id)``."""
    ids = doomed.select("file_id").distinct()
    return {name: table.join(ids, "file_id", "left_anti") for name, table in tables.items()}


def recent_rows(events: DataFrame, n: int = 5) -> DataFrame:
    """M9."""
    return events.orderBy(F.col("created_on").desc(), "file_id", "line_no").limit(n)
