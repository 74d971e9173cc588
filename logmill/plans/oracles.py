"""The registered queries in SQL, for the check against another engine.

Written from the meaning of each operator over the same tables; the renderings
at the top mirror ``inputs.py``.
"""

from __future__ import annotations

from logmill.functions import dims
from logmill.plans.inputs import FOLDERS, LINES_PER_FILE, ROWS_PER_TABLE, YEAR
from logmill.plans.queries import LINE_EPS, VECTOR_EPS

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def items(words: list[str]) -> str:
    return ", ".join(q(w) for w in words)


def case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {q(w)})::INT" for w in words) + ")"


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


TOKEN = r"[\p{L}\p{N}_]{2,}"
EDGE = r"[^\p{L}\p{N}_]"


def word(words: list[str]) -> str:
    return q(f"(?i)(^|{EDGE})({'|'.join(words)})($|{EDGE})")


def attack(name: str) -> str:
    return q(f"(?i)({'|'.join(dims.ATTACK_PATTERNS[name])})")


ATTACKS = list(dims.ATTACK_PATTERNS)

# --- renderings -------------------------------------------------------------------

BODY = """CASE
  WHEN event_id % 41 = 0 THEN 'Failed password for user u' || user_id
  WHEN event_id % 43 = 0 THEN 'SELECT * FROM users WHERE id=' || user_id || ' OR 1=1'
  WHEN event_id % 47 = 0 THEN '<script>alert(1)</script>'
  WHEN event_id % 53 = 0 THEN 'Accessing file: ../../etc/passwd'
  WHEN event_id % 59 = 0 THEN 'run ; cat /tmp/x'
  WHEN event_type = 'error' THEN 'Connection timeout: database unreachable at 10.0.' || (user_id % 256) || '.7'
  ELSE 'API request ' || event_type || ' by u' || user_id || '@example.com status ' || (200 + 100 * (event_id % 4))
END"""

LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"


def rendered(time: str) -> str:
    return f"""SELECT event_id AS row_id, value, 'evt-' || (event_id // {LINES_PER_FILE}) || '.log' AS file_id,
  event_id % {LINES_PER_FILE} + 1 AS line_no, {time} || ' ' || {LEVEL} || ' ' || {BODY} AS line FROM events"""


LOG = f"log_lines AS ({rendered("strftime(ts, '%Y-%m-%d %H:%M:%S')")})"
MIXED = "mixed_lines AS (" + rendered(
    """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%b %-d %H:%M:%S')
  ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') END"""
) + ")"


def lines_of(source: str, key: str, text: str, name: str, where: str = "true") -> str:
    """(file_id, line_no, line) of whole texts; a final line end starts no line."""
    return f"""{name} AS (SELECT file_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (
  SELECT {key} AS file_id, string_split(CASE WHEN ends_with({text}, chr(10)) THEN {text}[:-2] ELSE {text} END, chr(10)) AS l
  FROM {source} WHERE length({text}) > 0 AND {where}))"""


DOC_LINES = lines_of("documents", "'doc-' || doc_id", "text", "doc_lines")
PAGE_LINES = lines_of("pages", "'page-' || page_id", "html", "page_lines")
DOC_ROWS = (
    lines_of("documents", "doc_id", "text", "doc_id_lines")
    + ", doc_rows AS (SELECT file_id * 1000000 + line_no AS row_id, line AS text FROM doc_id_lines WHERE trim(line) <> '')"
)

UUID = "(md5(doc_id::VARCHAR)[1:8] || '-' || md5(doc_id::VARCHAR)[9:12] || '-' || md5(doc_id::VARCHAR)[13:16] || '-' || md5(doc_id::VARCHAR)[17:20] || '-' || md5(doc_id::VARCHAR)[21:32])"

FILES = f"""files AS (SELECT *, concat_ws('/', '/srv/cv-data/processed', [{items(FOLDERS)}][doc_id % {len(FOLDERS)} + 1], name) AS path FROM (
  SELECT doc_id, 'doc-' || doc_id AS file_id,
    CASE doc_id % 8 WHEN 0 THEN 'app-' || doc_id || '.log' WHEN 1 THEN 'notes-' || doc_id || '.TXT'
      WHEN 2 THEN 'data-' || doc_id || '.csv' WHEN 3 THEN 'API-' || doc_id || '.parquet'
      WHEN 4 THEN 'Email #' || doc_id || ' (new).log' WHEN 5 THEN 'scan-' || doc_id || '.pdf'
      WHEN 6 THEN {UUID} || '_up.log' ELSE 'pic-' || {UUID} || '.png' END AS name,
    n_chars + 100 AS size_bytes,
    CASE WHEN doc_id % 3 = 0 THEN [{items(dims.CLASSIFIER_LABELS)}][doc_id % {len(dims.CLASSIFIER_LABELS)} + 1] END AS label,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0 END AS score,
    doc_id % 5 <> 1 AS staged,
    CASE doc_id % 5 WHEN 0 THEN 'INFO service start' || chr(10)
      WHEN 1 THEN 'Curriculum Vitae. Education and skills.' || chr(10)
      WHEN 2 THEN 'Invoice: amount due, total and tax.' || chr(10)
      WHEN 3 THEN 'Resume with a career summary and proto notes.' || chr(10)
      ELSE 'Failed password for root' || chr(10) || 'SELECT * FROM t WHERE a=1 OR 1=1 -- x' || chr(10) END || text AS text
  FROM documents))"""

TABLE_COLUMNS = """table_columns AS (SELECT 'doc-' || doc_id AS file_id, unnest(['lang', 'n_chars',
  CASE doc_id % 4 WHEN 0 THEN 'Time Stamp' WHEN 1 THEN 'Description'
    WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'Severity' ELSE 'amount' END ELSE 'qty' END]) AS column_name FROM documents)"""

ORDER_TABLES = f"""order_tables AS (SELECT 'tbl-' || (o_orderkey // {ROWS_PER_TABLE}) AS file_id, o_orderkey, o_custkey,
  o_orderstatus, o_orderpriority FROM orders)"""

MASTER = """file_master AS (SELECT o_orderkey + 1 AS id, 'F' || o_orderkey AS file_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'Up-' || ((o_orderkey // 50) % 20) || '.log' ELSE 's-' || (o_orderkey - 1) || '.log' END AS original_filename,
  CASE WHEN o_orderkey % 50 = 33 THEN 'N/A' ELSE 's-' || o_orderkey || '.log' END AS stored_filename,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE 'staging/s-' || o_orderkey END AS raw_storage_path,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Pending' ELSE 'processed/s-' || o_orderkey END AS final_path,
  o_orderpriority AS category, 'N/A' AS cluster_id, 'N/A' AS summary,
  CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'P' THEN 'Failed' ELSE 'Processed' END AS status,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_on FROM orders)"""


def put(name: str, *ctes: str, select: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + select


# --- parsing ---------------------------------------------------------------------------


def cut(text: str, chars: int | None) -> str:
    return text if chars is None else f"left({text}, {chars})"


def findings(source: str, name: str = "findings", chars: int | None = None) -> str:
    parts = [
        f"""SELECT file_id, line_no, {no} AS category_no, {q(a)} AS type, {cut(strip('line'), chars)} AS content
  FROM {source} WHERE regexp_matches(line, {attack(a)})"""
        for no, a in enumerate(ATTACKS, start=1)
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def level(text: str) -> str:
    return case(
        [
            (f"regexp_matches({text}, {word(dims.ERROR_WORDS)})", "'ERROR'"),
            (f"regexp_matches({text}, {word(dims.WARNING_WORDS)})", "'WARNING'"),
        ],
        "NULL",
    )


def first_match(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, 0), '')"


def events(source: str, name: str = "ev", chars: int | None = None) -> str:
    flags = ", ".join(f"regexp_matches(t, {attack(a)}) AS a{no}" for no, a in enumerate(ATTACKS, 1))
    attacks = " UNION ALL ".join(
        f"""SELECT file_id, line_no, {no} AS category_no, 'Vulnerability' AS entry_type, {q(a)} AS vuln_type,
  '[' || {q(a)} || '] ' || {cut('t', chars)} AS message, t FROM {name}_f WHERE a{no}"""
        for no, a in enumerate(ATTACKS, 1)
    )
    clean = " AND ".join(f"NOT a{no}" for no in range(1, len(ATTACKS) + 1))
    return f"""{name}_f AS (SELECT *, {flags} FROM (SELECT file_id, line_no, {strip('line')} AS t FROM {source}) WHERE t <> ''),
{name} AS (SELECT file_id, line_no, category_no, entry_type, vuln_type, message, {first_match('t', dims.LINE_TIME)} AS logged_on FROM (
  {attacks} UNION ALL
  SELECT file_id, line_no, 0, {level('t')} AS entry_type, NULL, {cut('t', chars)}, t FROM {name}_f WHERE {clean})
  WHERE entry_type IS NOT NULL)"""


SIGNATURE = "CASE WHEN entry_type = 'Vulnerability' THEN vuln_type ELSE entry_type || ':' || message END"

put("line_timestamp", LOG, select=f"""SELECT file_id, line_no, {first_match('line', dims.LINE_TIME)} AS logged_on,
  strftime(strptime({first_match('line', dims.LINE_TIME)}, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS logged_ts FROM log_lines""")
put("line_level", LOG, select=f"SELECT file_id, line_no, coalesce({level('line')}, '-') AS level FROM log_lines")
put("scan_signatures", LOG, findings("log_lines"), select="SELECT file_id, line_no, type, content FROM findings")
put("scan_pages", PAGE_LINES, findings("page_lines"),
    select="SELECT file_id, type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM findings GROUP BY ALL")
put("scan_pages_of_heads", PAGE_LINES, findings("page_lines", chars=dims.FINDING_CHARS),
    select="SELECT file_id, type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM findings GROUP BY ALL")
put("page_events", PAGE_LINES, events("page_lines"),
    select="SELECT file_id, entry_type, count(*) AS n, sum(length(message))::BIGINT AS chars FROM ev GROUP BY ALL")
put("page_events_of_heads", PAGE_LINES, events("page_lines", chars=dims.MESSAGE_CHARS),
    select="SELECT file_id, entry_type, count(*) AS n, sum(length(message))::BIGINT AS chars FROM ev GROUP BY ALL")
put("extract_events", LOG, events("log_lines"), select="""SELECT file_id, line_no, category_no, entry_type, message, logged_on,
  strftime(strptime(logged_on, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS logged_ts FROM ev""")
put("split_vulns", LOG, events("log_lines"), select="""SELECT file_id, line_no,
  CASE WHEN entry_type = 'Vulnerability' THEN trim(replace(split_part(message, ']', 1), '[', '')) ELSE '-' END AS vuln_type, message FROM ev""")
put("keep_error_warning", LOG, events("log_lines"),
    select="SELECT file_id, line_no, entry_type FROM ev WHERE entry_type IN ('ERROR', 'WARNING')")
put("scan_summary", LOG, findings("log_lines"), select="""SELECT (SELECT count(DISTINCT file_id) FROM log_lines) AS files_scanned,
  (SELECT count(DISTINCT file_id) FROM findings) AS files_with_findings, (SELECT count(*) FROM findings) AS findings""")
put("flat_findings", PAGE_LINES, findings("page_lines"), select="""SELECT url AS name, type, count(*) AS n FROM findings
  JOIN pages ON file_id = 'page-' || page_id GROUP BY ALL""")
put("capped_report", LOG, findings("log_lines"), select="""SELECT file_id, rank_in_file, line_no, type, content, file_findings, greatest(file_findings - 5, 0) AS more
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no, category_no) AS rank_in_file,
    count(*) OVER (PARTITION BY file_id) AS file_findings FROM findings)
  WHERE rank_in_file <= 5 ORDER BY file_id, rank_in_file LIMIT 20""")


def scan_targets(api: bool) -> str:
    skip = dims.DOCUMENT_TYPES + (["structured_data", "other_document"] if api else [])
    return f"""targets AS (SELECT file_id, path FROM files
  WHERE NOT list_has_any(string_split(path, '/')[:-2], [{items(skip)}]) AND NOT starts_with(name, '.'))"""


BY_SUBSTRING = " OR ".join(f"contains(path, {q(t)})" for t in dims.DOCUMENT_TYPES)
put("scan_exclusions", FILES, scan_targets(False), select=f"SELECT file_id, {BY_SUBSTRING} AS excluded_by_substring FROM targets")
put("walk_scan_targets", FILES, scan_targets(True), select="""SELECT string_split(path, '/')[-2] AS folder, sum(strlen(text) + 1)::BIGINT AS size_bytes
  FROM files WHERE file_id IN (SELECT file_id FROM targets) GROUP BY ALL""")
put("security_scan", FILES, scan_targets(True), lines_of("files", "file_id", "text", "fl", "file_id IN (SELECT file_id FROM targets)"),
    findings("fl"), select="SELECT file_id, type, count(*) AS n FROM findings GROUP BY ALL")

# --- resolution ----------------------------------------------------------------------------

KNOWN = "(VALUES " + ", ".join(
    f"({q(t)}, {q(v[0])}, {q(v[1])}, {q(v[2])}, {q(v[3])})" for t, v in dims.FIXED_RESOLUTIONS.items()
) + ") AS known(vuln_type, severity, summary, solution, reference_url)"
DEFAULT = dict(zip(["severity", "summary", "solution", "reference_url"], dims.DEFAULT_RESOLUTION))
SOLUTION = "'Investigate the ' || entry_type || ' log: ' || message"
SEARCH = f"{q(dims.SEARCH_URL)} || replace(left(message, 100), ' ', '+')"
MILD = "CASE WHEN entry_type IN ('WARN', 'WARNING') THEN 'Medium' ELSE 'High' END"

CACHE = (
    "cache_lines AS (SELECT * FROM log_lines WHERE value >= 20), "
    + events("cache_lines", "cev")
    + f""", cache AS (SELECT DISTINCT {SIGNATURE} AS signature, 'Low' AS severity, 'Known issue.' AS summary,
  'See runbook for ' || left({SIGNATURE}, 7) AS solution, 'https://example.com/runbook' AS reference_url
  FROM cev WHERE entry_type IN ('ERROR', 'WARNING'))"""
)

put("dedupe_incidents",
    lines_of("documents", "'doc-' || doc_id", "text", "raw"),
    "tagged AS (SELECT file_id, line_no, 'Error: ' || line AS line FROM raw)", events("tagged"),
    select="""SELECT file_id, line_no, entry_type, message FROM ev WHERE entry_type IN ('ERROR', 'WARNING')
  QUALIFY row_number() OVER (PARTITION BY file_id, entry_type, message ORDER BY line_no) = 1""")
put("dedupe_incidents_of_heads",
    lines_of("documents", "'doc-' || doc_id", "text", "raw"),
    "tagged AS (SELECT file_id, line_no, 'Error: ' || line AS line FROM raw)", events("tagged"),
    select=f"""SELECT file_id, line_no, entry_type, message FROM ev WHERE entry_type IN ('ERROR', 'WARNING')
  QUALIFY row_number() OVER (PARTITION BY file_id, entry_type, left(message, {dims.DEDUPE_CHARS}) ORDER BY line_no) = 1""")
put("incident_signature_of_heads", LOG, events("log_lines"), select="SELECT file_id, line_no, " +
    SIGNATURE.replace("|| message", f"|| left(message, {dims.SIGNATURE_CHARS})") + " AS signature FROM ev")
put("incident_signature", LOG, events("log_lines"), select=f"SELECT file_id, line_no, {SIGNATURE} AS signature FROM ev")
put("cached_resolution", LOG, events("log_lines"), CACHE, select=f"""SELECT file_id, line_no, s.signature,
  coalesce(severity, '-') AS severity, coalesce(solution, '-') AS solution
  FROM (SELECT *, {SIGNATURE} AS signature FROM ev) s LEFT JOIN cache c ON s.signature = c.signature""")

ANSWERS = f"""answers AS (SELECT 'sig-' || event_id AS signature,
  [{items(list(dims.FIXED_RESOLUTIONS) + ['Unknown Attack'])}][event_id % 6 + 1] AS vuln_type,
  CASE event_id % 5
    WHEN 0 THEN '{{"severity": "High", "summary": "s' || event_id || '", "solution": "Patch it", "reference_url": "https://example.com/' || event_id || '", "cve_id": ""}}'
    WHEN 1 THEN 'Here you go:' || chr(10) || '{{"severity": "Low", "solution": "Restart ' || event_id || '", "cve_id": "CVE-2021-' || event_id || '"}}' || chr(10) || 'Good luck.'
    WHEN 2 THEN '{{"summary": "list", "solution": ["Step one", "Step ' || event_id || '"]}}'
    WHEN 3 THEN '{{"severity": "High", "solution": ' || event_id
    ELSE 'Sorry, I cannot help with ' || event_id END AS response FROM events WHERE event_type = 'error')"""


def fixed(column: str) -> str:
    return f"coalesce(k.{column}, {q(DEFAULT[column])})"


put("fallback_vuln_resolution", ANSWERS, select=f"""SELECT signature, a.vuln_type, {fixed('severity')} AS severity, {fixed('summary')} AS summary,
  {fixed('solution')} AS solution, {fixed('reference_url')} AS reference_url FROM answers a LEFT JOIN {KNOWN.replace('AS known', 'AS k')} ON a.vuln_type = k.vuln_type""")
put("fallback_incident_resolution", LOG, events("log_lines"), select=f"""SELECT file_id, line_no, {MILD} AS severity, '' AS summary,
  {SOLUTION} AS solution, {SEARCH} AS reference_url FROM ev WHERE entry_type IN ('ERROR', 'WARNING')""")
put("fallback_incident_strict", LOG, events("log_lines"), select="""SELECT file_id, line_no, entry_type,
  CASE WHEN entry_type = 'WARN' THEN 'Medium' ELSE 'High' END AS severity FROM ev WHERE entry_type IN ('ERROR', 'WARNING')""")
put("cache_upsert", LOG, events("log_lines"), CACHE, select=f"""SELECT * FROM cache UNION ALL
  SELECT * FROM (SELECT {SIGNATURE} AS signature, {MILD} AS severity, '' AS summary, {SOLUTION} AS solution, {SEARCH} AS reference_url
    FROM ev WHERE entry_type IN ('ERROR', 'WARNING')
    QUALIFY row_number() OVER (PARTITION BY {SIGNATURE} ORDER BY {MILD}, {SOLUTION}) = 1) n
  WHERE signature NOT IN (SELECT signature FROM cache)""")
put("parse_resolution_json", ANSWERS, f"""read AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS doc
  FROM (SELECT *, regexp_extract(response, '(?s)\\{{.*\\}}', 0) AS body FROM answers))""", f"""parts AS (SELECT signature, vuln_type, doc, json_extract_string(doc, '$.severity') AS sev, json_extract_string(doc, '$.summary') AS summ,
  CASE WHEN json_type(doc, '$.solution') = 'ARRAY' THEN array_to_string(from_json(json_extract(doc, '$.solution'), '["VARCHAR"]'), ' ')
    ELSE json_extract_string(doc, '$.solution') END AS sol,
  json_extract_string(doc, '$.reference_url') AS url, json_extract_string(doc, '$.cve_id') AS cve FROM read)""",
    select=f"""SELECT signature, p.vuln_type,
  CASE WHEN doc IS NULL THEN {fixed('severity')} ELSE coalesce(sev, 'Medium') END AS severity,
  CASE WHEN doc IS NULL THEN {fixed('summary')} ELSE coalesce(summ, {q(DEFAULT['summary'])}) END AS summary,
  CASE WHEN doc IS NULL THEN {fixed('solution')} WHEN starts_with(cve, 'CVE-') THEN '[CVE: ' || cve || '] ' || coalesce(sol, {q(dims.ANSWER_DEFAULT_SOLUTION)})
    ELSE coalesce(sol, {q(dims.ANSWER_DEFAULT_SOLUTION)}) END AS solution,
  CASE WHEN doc IS NULL THEN {fixed('reference_url')} ELSE coalesce(url, {fixed('reference_url')}) END AS reference_url
  FROM parts p LEFT JOIN {KNOWN.replace('AS known', 'AS k')} ON p.vuln_type = k.vuln_type""")

RESOLVED = f"""incidents AS (SELECT * FROM ev WHERE entry_type = 'Vulnerability' UNION ALL
  SELECT * FROM ev WHERE entry_type IN ('ERROR', 'WARNING')
  QUALIFY row_number() OVER (PARTITION BY file_id, entry_type, message ORDER BY line_no) = 1),
resolved AS (SELECT file_id, line_no, category_no, entry_type, s.vuln_type, message, logged_on, s.signature,
  coalesce(c.severity, CASE WHEN entry_type = 'Vulnerability' THEN {fixed('severity')} ELSE {MILD} END) AS severity,
  coalesce(c.summary, CASE WHEN entry_type = 'Vulnerability' THEN {fixed('summary')} ELSE '' END) AS summary,
  coalesce(c.solution, CASE WHEN entry_type = 'Vulnerability' THEN {fixed('solution')} ELSE {SOLUTION} END) AS solution,
  coalesce(c.reference_url, CASE WHEN entry_type = 'Vulnerability' THEN {fixed('reference_url')} ELSE {SEARCH} END) AS reference_url
  FROM (SELECT *, {SIGNATURE} AS signature FROM incidents) s LEFT JOIN cache c ON s.signature = c.signature
  LEFT JOIN {KNOWN.replace('AS known', 'AS k')} ON s.vuln_type = k.vuln_type)"""
RES = (LOG, events("log_lines"), CACHE, RESOLVED)
UNIFIED = """file_id, line_no, category_no, entry_type, message, severity, solution AS resolution, summary AS resolution_summary,
  reference_url, logged_on"""
put("resolve_incidents", *RES, select="SELECT file_id, line_no, category_no, entry_type, signature, severity, summary, solution, reference_url FROM resolved")
ANSWERED = {
    "severity": ("'Low'", "'High'"), "summary": ("'Seen before.'", "''"), "reference_url": ("'https://example.com/seen'", "''"),
    "solution": ("'Look at it. Length ' || length(s.signature) || '.'", "'Manual investigation required.'"),
}


def answered(field: str) -> str:
    """The answer to a request of this length; a failed call about an attack gives the fixed text."""
    given, failed = ANSWERED[field]
    return f"""CASE length(s.signature) % 3 WHEN 1 THEN {given} WHEN 2 THEN CASE WHEN s.vuln_type IS NULL THEN {failed} ELSE {fixed(field)} END END"""


WITH_ANSWERS = RESOLVED
for name in ANSWERED:
    WITH_ANSWERS = WITH_ANSWERS.replace(f"coalesce(c.{name}, CASE", f"coalesce(c.{name}, {answered(name)}, CASE")
put("resolve_with_answers", LOG, events("log_lines"), CACHE, WITH_ANSWERS,
    select="SELECT file_id, line_no, category_no, entry_type, signature, severity, summary, solution, reference_url FROM resolved")
put("answers_to_cache", LOG, events("log_lines"), CACHE, f"""asked AS (SELECT {SIGNATURE} AS signature, vuln_type FROM ev
  WHERE {SIGNATURE} NOT IN (SELECT signature FROM cache) GROUP BY ALL)""", select=f"""SELECT * FROM cache UNION ALL
  SELECT s.signature, {answered('severity')}, {answered('summary')}, {answered('solution')}, {answered('reference_url')}
  FROM asked s LEFT JOIN {KNOWN.replace('AS known', 'AS k')} ON s.vuln_type = k.vuln_type WHERE length(s.signature) % 3 <> 0""")
put("events_of_file", *RES, f"""one AS (SELECT min(file_id) AS f FROM ev WHERE entry_type IN ('ERROR', 'WARNING'))""", select="""SELECT 'event' AS kind, file_id, line_no, category_no, entry_type FROM resolved, one WHERE file_id = f
  UNION ALL SELECT 'vulnerability', file_id, line_no, category_no, entry_type FROM resolved, one WHERE file_id = f AND entry_type = 'Vulnerability'""")
put("unified_events", *RES, select=f"SELECT {UNIFIED} FROM resolved")
put("append_events", *RES, select="SELECT file_id, line_no, category_no, entry_type, severity, solution AS resolution, reference_url FROM resolved")
put("append_vulns", LOG, events("log_lines"), select=f"""SELECT file_id, line_no, e.vuln_type, {fixed('severity')} AS severity, {fixed('solution')} AS solution,
  {fixed('summary')} AS resolution_summary, {fixed('reference_url')} AS reference_url
  FROM ev e LEFT JOIN {KNOWN.replace('AS known', 'AS k')} ON e.vuln_type = k.vuln_type WHERE entry_type = 'Vulnerability'""")
put("list_events", *RES, select="""SELECT file_id, line_no, entry_type, coalesce(severity, 'Medium') AS priority, message, logged_on AS created_on
  FROM resolved WHERE entry_type = 'ERROR' ORDER BY logged_on DESC, file_id, line_no, category_no LIMIT 100""")
put("list_vulns", *RES, select="""SELECT file_id, line_no, vuln_type, severity, solution, logged_on AS analyzed_on
  FROM resolved WHERE entry_type = 'Vulnerability' AND severity = 'High' ORDER BY logged_on DESC, file_id, line_no, category_no LIMIT 100""")
put("recent_rows", LOG, events("log_lines"), select="""SELECT file_id, line_no, entry_type, logged_on AS created_on FROM ev
  ORDER BY logged_on DESC, file_id, line_no LIMIT 5""")
put("resolution_requests", LOG, events("log_lines"), CACHE, select=f"""SELECT signature, entry_type, vuln_type,
  CASE WHEN entry_type = 'Vulnerability' THEN 'Analyze this vulnerability. Vulnerability Type: ' || vuln_type
    ELSE 'Analyze this log incident. Log Level: ' || entry_type END || chr(10) || 'Log Message: ' || message || chr(10) ||
  'Answer as JSON with the keys severity (High, Medium or Low), summary, solution, reference_url and cve_id (empty when none applies).' AS prompt
  FROM (SELECT *, {SIGNATURE} AS signature FROM ev QUALIFY row_number() OVER (PARTITION BY {SIGNATURE} ORDER BY file_id, line_no) = 1)
  WHERE signature NOT IN (SELECT signature FROM cache)""")
put("incident_totals", *RES, select="SELECT entry_type, severity, count(*) AS n, count(DISTINCT file_id) AS files FROM resolved GROUP BY ALL")
put("stream_events", LOG, events("log_lines"),
    select="SELECT entry_type, coalesce(vuln_type, '-') AS vuln_type, count(*) AS n FROM ev GROUP BY ALL")

put("stream_dedupe", LOG, events("log_lines"), select="""SELECT file_id, entry_type, count(DISTINCT message) AS n FROM ev GROUP BY ALL""")
put("stream_hourly", LOG, events("log_lines"), select="""SELECT file_id,
  strftime(date_trunc('hour', strptime(logged_on, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS hour_start, count(*) AS events FROM ev GROUP BY ALL""")

# --- sources and sinks ---------------------------------------------------------------------------

put("read_log_lines", LOG, select="SELECT file_id, line_no, line FROM log_lines")
put("read_csv_table", select="""SELECT p_partkey, 'the "' || p_name || '", new' || chr(10) || 'and old' AS p_name, p_brand, p_type, p_size FROM part""")
put("read_parquet_table", select="SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
EXT = "lower(string_split(name, '.')[-1])"
STATUS = f"""CASE WHEN {EXT} IN ({items(dims.STRUCTURED_EXTENSIONS)}) THEN 'structured'
  WHEN {EXT} IN ({items(dims.TEXT_EXTENSIONS)}) THEN 'text' ELSE 'unsupported' END"""
put("ingest_status", FILES, select=f"SELECT file_id, {EXT} AS ext, {STATUS} AS status FROM files")
put("list_landing_files", LOG, select="SELECT file_id, sum(strlen(line) + 1)::BIGINT AS size_bytes FROM log_lines GROUP BY ALL UNION ALL SELECT '_SUCCESS', 0")
put("load_master_csv", MASTER, select="""SELECT file_id, original_filename, CASE WHEN status = 'Failed' THEN 'from the old report' ELSE summary END AS summary, status
  FROM file_master""")


def by_domain(text: str) -> str:
    scores = {c: hits(f"lower({text})", w) for c, w in dims.DOMAIN_KEYWORDS.items()}
    best = f"greatest({', '.join(scores.values())})"
    return case([(f"{best} = 0", dynamic(text))] + [(f"{s} = {best}", q(c)) for c, s in list(scores.items())[:-1]], q(list(scores)[-1]))


def dynamic(text: str) -> str:
    found = f"regexp_extract_all(string_split(lower({text}), 'keywords:')[-1], '[a-z]{{3,}}')"
    return f"coalesce(list_filter({found}, lambda w: w NOT IN ({items(dims.CATEGORY_STOP_WORDS)}))[1], 'unstructured_log')"


put("write_by_category", LOG, select=f"SELECT {by_domain('line')} AS category, file_id, count(*) AS lines FROM log_lines GROUP BY ALL")

# --- classification ---------------------------------------------------------------------------------

def fast(chars: int | None = None) -> str:
    found = " OR ".join(f"contains(upper({cut('text', chars)}), {q(w)})" for w in dims.FAST_PATH_WORDS)
    return f"""(regexp_matches(lower(name), '\\.(log|txt)$') AND ({found}))"""


FAST = fast()
SCORES = ", ".join(f"{hits('head', w)} AS s_{c}" for c, w in dims.CLASS_KEYWORDS.items())
SCORED = f"scored AS (SELECT *, {SCORES} FROM (SELECT *, lower(text) AS head FROM files))"
BEST = f"greatest({', '.join('s_' + c for c in dims.CLASS_KEYWORDS)})"
KEY_CLASS = case(
    [(f"{BEST} = 0", f"CASE WHEN {EXT} IN ('log', 'txt') THEN 'log' ELSE 'other_document' END")]
    + [(f"s_{c} = {BEST}", q(c)) for c in dims.CLASS_KEYWORDS], "NULL")
KEY_CONF = f"CASE WHEN {BEST} = 0 THEN CASE WHEN {EXT} IN ('log', 'txt') THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END ELSE least({BEST}::DOUBLE / 10, 0.9::DOUBLE) END"
NORMAL = """CASE WHEN contains(lower(label), 'log') THEN 'log' WHEN contains(lower(label), 'curriculum vitae') THEN 'cv'
  WHEN contains(lower(label), 'resume') THEN 'resume' WHEN contains(lower(label), 'invoice') THEN 'invoice'
  WHEN contains(lower(label), 'report') THEN 'report' WHEN contains(lower(label), 'contract') OR contains(lower(label), 'agreement') THEN 'contract'
  ELSE lower(replace(label, ' ', '_')) END"""
CLASSIFIED = f"""classified AS (SELECT *, CASE WHEN {FAST} THEN 'log' WHEN label IS NOT NULL THEN {NORMAL} ELSE {KEY_CLASS} END AS category,
  CASE WHEN {FAST} THEN 1.0::DOUBLE WHEN label IS NOT NULL THEN score::DOUBLE ELSE {KEY_CONF} END AS confidence FROM scored)"""
EVIDENCE = " OR ".join(f"contains(lower(text), {q(w)})" for w in dims.LOG_EVIDENCE)


def recheck(kind: str) -> str:
    return f"CASE WHEN {kind} = 'log' AND confidence < 0.6 AND NOT ({EVIDENCE}) THEN 'other_document' ELSE {kind} END"


LOG_TABLES = f"""log_tables AS (SELECT file_id, bool_or({' OR '.join(f"contains(lower(column_name), {q(w)})" for w in dims.LOG_COLUMN_WORDS)}) AS is_log_table
  FROM table_columns GROUP BY file_id)"""
TYPED = f"""typed AS (SELECT file_id, {STATUS} AS ingest_status, CASE WHEN {STATUS} = 'unsupported' THEN 'unsupported' ELSE
  {recheck(f"(CASE WHEN {STATUS} = 'structured' AND is_log_table THEN 'log' ELSE category END)")} END AS file_type
  FROM classified JOIN log_tables USING (file_id))"""
put("log_fast_path", FILES, select=f"SELECT file_id, {FAST} AS is_log FROM files")
put("keyword_file_class", FILES, SCORED, select=f"SELECT file_id, {KEY_CLASS} AS category, round({KEY_CONF}, 6) AS confidence FROM scored")
put("log_fast_path_of_heads", FILES, select=f"SELECT file_id, {fast(dims.FAST_PATH_CHARS)} AS is_log FROM files")
put("keyword_file_class_of_heads", FILES, SCORED.replace("lower(text)", f"lower(left(text, {dims.CLASSIFY_CHARS}))"),
    select=f"SELECT file_id, {KEY_CLASS} AS category, round({KEY_CONF}, 6) AS confidence FROM scored")
put("classify_file", FILES, SCORED, CLASSIFIED, select="SELECT file_id, category, round(confidence, 6) AS confidence FROM classified")
put("normalize_label", FILES, select=f"SELECT file_id, label, {NORMAL} AS category FROM files WHERE label IS NOT NULL")
put("log_like_columns", TABLE_COLUMNS, LOG_TABLES, select="SELECT * FROM log_tables")
put("low_confidence_recheck", FILES, SCORED, CLASSIFIED, select=f"SELECT file_id, category, {recheck('category')} AS checked FROM classified")
put("final_file_type", FILES, SCORED, CLASSIFIED, TABLE_COLUMNS, LOG_TABLES, TYPED, select="SELECT file_id, ingest_status, file_type FROM typed")
OWN = items(dims.ROUTED_DOCUMENT_TYPES + ["structured_data"])
put("route_files", FILES, SCORED, CLASSIFIED, TABLE_COLUMNS, LOG_TABLES, TYPED, select=f"""SELECT file_id, file_type,
  CASE WHEN file_type IN ({OWN}) THEN file_type WHEN file_type = 'unsupported' THEN '-' ELSE 'staging' END AS destination,
  file_type NOT IN ({OWN}, 'unsupported', 'error') AS goes_to_analysis FROM typed""")
CELLS = "concat_ws({sep}, o_orderkey, o_custkey, o_orderstatus, o_orderpriority)"
put("table_sample_text", ORDER_TABLES, select=f"""SELECT file_id, 'Table Columns: o_orderkey, o_custkey, o_orderstatus, o_orderpriority' || chr(10) || 'Data Sample:' || chr(10) ||
  string_agg({CELLS.format(sep="' '")}, chr(10) ORDER BY o_orderkey) AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY o_orderkey) AS rn FROM order_tables) WHERE rn <= 10 GROUP BY file_id""")
put("table_line_table", ORDER_TABLES, select=f"""SELECT file_id, line_no, {CELLS.format(sep="' | '")} AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY o_orderkey) AS line_no FROM order_tables)""")
put("table_line_table_of_first_rows", ORDER_TABLES, select=f"""SELECT file_id, line_no, {CELLS.format(sep="' | '")} AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY o_orderkey) AS line_no FROM order_tables)
  WHERE line_no <= {dims.TABLE_ROWS}""")

# --- audit table -----------------------------------------------------------------------------------------

put("profile_files", FILES, DOC_LINES, select="""SELECT file_id, name AS original_filename,
  CASE WHEN staged AND NOT contains(name, 'API') THEN name ELSE 'N/A' END AS stored_filename,
  CASE WHEN contains(name, 'API') THEN 'External API' WHEN staged AND contains(name, 'Email') THEN 'Email Attachment' ELSE 'Local Upload' END AS source_type,
  CASE WHEN staged AND NOT contains(name, 'API') THEN path ELSE 'N/A' END AS raw_storage_path,
  'Pending' AS final_path, 'Pending' AS category, 'N/A' AS cluster_id, 'N/A' AS summary,
  CASE WHEN staged AND NOT contains(name, 'API') THEN round(size_bytes::DOUBLE / 1024, 2) ELSE 0.0::DOUBLE END AS file_size_kb,
  coalesce(n, 0) AS row_count, CASE WHEN staged OR contains(name, 'API') THEN 'Success' ELSE 'Routed' END AS status
  FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM doc_lines GROUP BY file_id) USING (file_id)""")
put("insert_if_absent", select="""SELECT o_orderkey AS file_id, 'stored' AS origin, 0 AS part FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT l_orderkey, 'new', min(l_partkey) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') GROUP BY l_orderkey""")
put("update_by_name", MASTER, """last AS (SELECT 's-' || l_orderkey || '.log' AS stored_filename, 'cat_' || l_suppkey AS category,
  'processed/new/s-' || l_orderkey AS final_path, l_partkey::VARCHAR AS cluster_id, 'Test summary ' || l_partkey AS summary FROM lineitem
  WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1)""",
    select="""SELECT m.file_id, coalesce(l.category, m.category) AS category, coalesce(l.final_path, m.final_path) AS final_path,
  coalesce(l.cluster_id, m.cluster_id) AS cluster_id, coalesce(l.summary, m.summary) AS summary,
  CASE WHEN l.summary IS NOT NULL THEN 'Processed' ELSE m.status END AS status
  FROM file_master m LEFT JOIN last l ON m.stored_filename = l.stored_filename""")
put("list_files", MASTER, select="""SELECT file_id, original_filename, category, status, created_on FROM file_master WHERE status = 'Processed'
  ORDER BY created_on DESC, file_id LIMIT 100""")
CHAIN = """links AS (SELECT m.id, n.next_id FROM file_master m JOIN (SELECT original_filename AS name, max(id) AS next_id FROM file_master GROUP BY 1) n
    ON m.stored_filename = n.name WHERE n.next_id > m.id AND m.stored_filename <> 'N/A' AND m.stored_filename <> m.original_filename),
chain(id, here) AS (SELECT id, id FROM file_master UNION ALL SELECT c.id, l.next_id FROM chain c JOIN links l ON c.here = l.id),
ends AS (SELECT id, max(here) AS end_id FROM chain GROUP BY id)"""
TARGET = "CASE WHEN final_path <> 'Pending' THEN final_path WHEN raw_storage_path <> 'N/A' THEN raw_storage_path ELSE '-' END"
ORACLES["resolve_path"] = f"""WITH RECURSIVE {MASTER}, {CHAIN}, start AS (SELECT original_filename AS asked, max(id) AS id FROM file_master GROUP BY 1)
SELECT s.asked AS original_filename, e.end_id, {TARGET} AS path FROM start s JOIN ends e ON s.id = e.id JOIN file_master t ON t.id = e.end_id"""
ORACLES["resolve_one_path"] = f"""WITH RECURSIVE {MASTER}, {CHAIN}, start AS (SELECT coalesce(max(id) FILTER (WHERE original_filename = 'up-7'), max(id)) AS id
  FROM file_master WHERE contains(lower(original_filename), 'up-7'))
SELECT 'up-7' AS name, e.end_id, {TARGET} AS path FROM start s JOIN ends e ON s.id = e.id JOIN file_master t ON t.id = e.end_id"""
put("cascade_delete", select="""SELECT 'file_master' AS table_name, o_orderkey AS file_id, 1 AS rows_left FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'line_items', l_orderkey, count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey""")
put("file_uuid", FILES, select=f"""SELECT name, coalesce({first_match('name', dims.UUID_PATTERN)}, 'AUDIT-' || left(sha256(path), 16)) AS file_id,
  coalesce({first_match('name', '^' + dims.UUID_PATTERN)}, name) AS event_file_id FROM files""")
put("safe_name", FILES, select=f"SELECT file_id, trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}} ._-]', '', 'g')) AS safe_name FROM files")

# --- texts --------------------------------------------------------------------------------------------------


def clean(text: str) -> str:
    bare = f"regexp_replace({text}, '\\p{{Nd}}+', '', 'g')"
    return strip(f"lower(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'))")


def words(text: str, stops: list[str]) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), {q(TOKEN)}), lambda w: w NOT IN ({items(stops)}))"


LINE_STOPS = dims.ENGLISH_STOP_WORDS + dims.LINE_STOP_WORDS
put("clean_line", DOC_LINES, select=f"SELECT file_id, line_no, md5({clean('line')}) AS cleaned_md5 FROM doc_lines")
put("line_table", DOC_LINES, select=f"SELECT file_id, line_no, md5({strip('line')}) AS line_md5 FROM doc_lines WHERE {strip('line')} <> ''")
TERMS = f"""doc_words AS (SELECT doc_id, text, {words('text', dims.ENGLISH_STOP_WORDS)} AS w FROM documents),
grams AS (SELECT doc_id, unnest(w) AS term FROM doc_words UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM doc_words),
terms AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY doc_id, term
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= {dims.MAX_TERMS})"""
put("term_counts", TERMS, select="SELECT * FROM terms")
put("keyword_candidates", TERMS, select=f"""SELECT doc_id, term, n, false AS fallback FROM terms WHERE term NOT IN ({items(dims.SUMMARY_STOP_WORDS)})
  UNION ALL SELECT doc_id, replace(left(text, 200), chr(10), ' '), 0, true FROM documents WHERE {strip('text')} <> ''
  AND doc_id NOT IN (SELECT doc_id FROM terms WHERE term NOT IN ({items(dims.SUMMARY_STOP_WORDS)}))""")


def tfidf(source: str, key: str, stops: list[str]) -> str:
    """(key, term, n, weight) of (key, text)."""
    return f"""tok AS (SELECT {key}, unnest({words('text', stops)}) AS term FROM {source}),
tf AS (SELECT {key}, term, count(*) AS n FROM tok GROUP BY ALL),
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term
  ORDER BY sum(n) DESC, term LIMIT {dims.MAX_TERMS}),
raw_weights AS (SELECT {key}, term, n, n * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (SELECT {key}, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM raw_weights)"""


put("tfidf", DOC_ROWS, tfidf("doc_rows", "row_id", LINE_STOPS), select="SELECT row_id, term, round(weight, 6) AS weight FROM weights")
put("doc_sample", select="""SELECT doc_id, length(sample) AS chars, md5(sample) AS sample_md5 FROM (
  SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 1500) || right(text, 1500) ELSE text END AS sample FROM documents)""")
put("file_summary", tfidf("documents", "doc_id", dims.ENGLISH_STOP_WORDS),
    f"""kw AS (SELECT doc_id, string_agg(term, ', ' ORDER BY rk) AS keywords FROM (
  SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rk FROM weights
  WHERE term NOT IN ({items(dims.SUMMARY_STOP_WORDS)})) WHERE rk <= {dims.TOP_KEYWORDS} GROUP BY doc_id)""",
    select=f"""SELECT doc_id, coalesce('Total Entries: ' || (len(string_split(text, chr(10))) - ends_with(text, chr(10))::INT) || '. Keywords: ' || keywords,
  replace(left(text, 200), chr(10), ' ')) AS summary FROM documents LEFT JOIN kw USING (doc_id) WHERE {strip('text')} <> ''""")
put("category_by_domain", FILES, select=f"SELECT file_id, {by_domain('text')} AS category FROM files")
PREFIXED = "('Total Entries: 3. Keywords: log, ' || text)"
put("category_dynamic", FILES, select=f"SELECT file_id, {dynamic(PREFIXED)} AS category FROM files")

# --- clusters ------------------------------------------------------------------------------------------------

CLEAN_ROWS = f"""clean_rows AS (SELECT row_id, file_id, line_no, {strip('line')} AS line, {clean(strip('line'))} AS cleaned FROM log_lines WHERE {strip('line')} <> '')"""
LABELS = """labels AS (SELECT row_id, cleaned, CASE WHEN count(*) OVER (PARTITION BY cleaned) >= 5
  THEN min(row_id) OVER (PARTITION BY cleaned) ELSE -1 END AS cluster_id FROM clean_rows)"""
CLEAN_TEXT = "clean_text AS (SELECT row_id, cleaned AS text FROM clean_rows)"
TOP = """top_terms AS (SELECT cluster_id, term, mean_weight, row_number() OVER (PARTITION BY cluster_id ORDER BY mean_weight DESC, term) AS rank FROM (
  SELECT cluster_id, term, round(sum(weight) / (SELECT count(*) FROM labels x WHERE x.cluster_id = l.cluster_id), 6) AS mean_weight
  FROM weights JOIN labels l USING (row_id) WHERE cluster_id <> -1 GROUP BY cluster_id, term) QUALIFY rank <= 10)"""
DOMAIN_SUMS = {c: f"sum((term IN ({items(w)}))::INT)" for c, w in dims.DOMAIN_KEYWORDS.items()}
DOMAIN_BEST = f"greatest({', '.join(DOMAIN_SUMS.values())})"
NAMED = f"""named AS (SELECT cluster_id, CASE WHEN cluster_id = -1 THEN 'unstructured_log' ELSE coalesce(named, 'app_log') END AS category
  FROM (SELECT DISTINCT cluster_id FROM labels) LEFT JOIN (SELECT cluster_id,
    {case([(f"{DOMAIN_BEST} = 0", "'app_log'")] + [(f"{s} = {DOMAIN_BEST}", q(c)) for c, s in DOMAIN_SUMS.items()], "NULL")} AS named
    FROM top_terms GROUP BY cluster_id) USING (cluster_id))"""
CLUSTERED = (LOG, CLEAN_ROWS, LABELS, CLEAN_TEXT, tfidf("clean_text", "row_id", LINE_STOPS), TOP, NAMED,
             "clustered AS (SELECT r.*, l.cluster_id, n.category FROM clean_rows r JOIN labels l USING (row_id) JOIN named n USING (cluster_id))")
put("template_clusters", LOG, CLEAN_ROWS, LABELS, select="SELECT row_id, cluster_id FROM labels")
put("cluster_top_terms", *CLUSTERED, select="SELECT cluster_id, term, mean_weight, rank FROM top_terms")
put("cluster_label", *CLUSTERED, select="SELECT cluster_id, category FROM named")
put("majority_category", *CLUSTERED, select="""SELECT file_id, category, count(*) AS n FROM clustered GROUP BY file_id, category
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, category) = 1""")
put("write_cluster_report", *CLUSTERED, select="""SELECT file_id AS file_name, 'Total Entries: ' || count(*) AS summary, cluster_id, category
  FROM clustered GROUP BY file_id, cluster_id, category""")
put("write_lines_by_category", *CLUSTERED, select="""SELECT line AS original_log, file_id AS source_file, cleaned AS cleaned_log, cluster_id, category FROM clustered""")


def line_clusters(rows: str) -> str:
    """labels(row_id, cluster_id) from weights: connected by distances up to LINE_EPS."""
    return f"""vec AS (SELECT row_id, list({{'t': term, 'w': round(weight, 9)}} ORDER BY term) AS v FROM weights GROUP BY row_id),
shaped AS (SELECT r.row_id, coalesce(v::VARCHAR, '') AS key, v FROM {rows} r LEFT JOIN vec USING (row_id)),
pts AS (SELECT key, min(row_id) AS point, count(*) AS weight, any_value(v) AS v FROM shaped GROUP BY key),
flat AS (SELECT point, t.t AS term, t.w AS w FROM (SELECT point, unnest(v) AS t FROM pts)),
half AS (SELECT x.point AS a, y.point AS b FROM flat x JOIN flat y ON x.term = y.term AND x.point < y.point
  GROUP BY 1, 2 HAVING sqrt(2 - 2 * least(sum(x.w * y.w), 1)) <= {LINE_EPS} + 1e-9),
edges AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(node, root) AS (SELECT point, point FROM pts UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node AND e.b > r.root),
comps AS (SELECT node AS point, min(root) AS root FROM reach GROUP BY node),
point_labels AS (SELECT key, CASE WHEN sum(weight) OVER (PARTITION BY root) >= 5 THEN root ELSE -1 END AS cluster_id FROM pts JOIN comps USING (point)),
labels AS (SELECT row_id, cluster_id FROM shaped JOIN point_labels USING (key))"""


put("density_clusters_lines", DOC_ROWS, tfidf("doc_rows", "row_id", LINE_STOPS), line_clusters("doc_rows"),
    select="SELECT row_id, cluster_id FROM labels")
put("small_run", LOG, CLEAN_ROWS, CLEAN_TEXT, tfidf("clean_text", "row_id", LINE_STOPS), line_clusters("clean_text"), TOP, NAMED,
    "clustered AS (SELECT r.*, l.cluster_id, n.category FROM clean_rows r JOIN labels l USING (row_id) JOIN named n USING (cluster_id))",
    select="""SELECT file_id AS stored_filename, category, 'processed/' || category || '/' || file_id AS final_path, 'Line-Level' AS cluster_id,
  'Processed via HDBSCAN clustering. Majority category: ' || category AS summary FROM (
  SELECT file_id, category, count(*) AS n FROM clustered GROUP BY file_id, category
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, category) = 1)""")
for _name in ("density_clusters_lines", "small_run"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["density_clusters_files"] = f"""WITH RECURSIVE edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {VECTOR_EPS}),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comps AS (SELECT node AS row_id, min(root) AS root FROM reach GROUP BY node)
SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY root) >= 3 THEN root ELSE -1 END AS cluster_id FROM comps"""

# --- reports --------------------------------------------------------------------------------------------------

NONBLANK = f"nonblank AS (SELECT * FROM doc_lines WHERE {strip('line')} <> '')"
COUNTED = "counted AS (SELECT file_id, line, count(*) AS n, min(line_no) AS first_line FROM nonblank GROUP BY file_id, line)"
put("line_duplicates", DOC_LINES, NONBLANK, COUNTED, select="""SELECT file_id, sum(n)::BIGINT AS total_lines, count(*) AS unique_lines,
  sum(n - 1)::BIGINT AS redundant_lines FROM counted GROUP BY file_id""")
put("top_recurring_lines", DOC_LINES, NONBLANK, COUNTED, select="""SELECT file_id, rank, n, CASE WHEN length(line) > 75 THEN left(line, 75) || '...' ELSE line END AS display, line
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first_line) AS rank FROM counted WHERE n > 1) WHERE rank <= 5""")
put("row_duplicates", select="""SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_returnflag)""")
put("top_row_values", select="""SELECT l_quantity, l_discount, l_returnflag, count(*) AS n FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL
  GROUP BY l_quantity, l_discount, l_returnflag ORDER BY n DESC, l_quantity, l_discount, l_returnflag LIMIT 5""")
SHAPES = {k: v[0] for k, v in dims.TIME_SHAPES.items()}
TIMED = f"""timed AS (SELECT file_id, line_no, coalesce(try_strptime(f, '%Y-%m-%d %H:%M:%S'), try_strptime(f, '%Y-%m-%dT%H:%M:%S'),
  try_strptime('{YEAR} ' || f, '%Y %b %d %H:%M:%S'), try_strptime(f, '%d/%b/%Y:%H:%M:%S')) AS t
  FROM (SELECT file_id, line_no, {first_match('line', '|'.join(f'(?:{s})' for s in SHAPES.values()))} AS f FROM mixed_lines) WHERE f IS NOT NULL)"""
put("timeline_text", MIXED, TIMED, select="""SELECT file_id, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS end_ts,
  date_diff('second', min(t), max(t)) AS duration_seconds, count(*) AS events FROM timed WHERE t IS NOT NULL GROUP BY file_id""")
put("timeline_table", select="""SELECT 'o_orderdate' AS time_column, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS start_ts,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS end_ts, count(*) AS entries FROM orders""")
put("hourly_histogram", MIXED, TIMED, select="SELECT file_id, hour(t) AS hour, count(*) AS events FROM timed WHERE t IS NOT NULL GROUP BY ALL")
put("peak_hour", MIXED, TIMED, select="""SELECT file_id, hour(t) AS peak_hour, count(*) AS events FROM timed WHERE t IS NOT NULL GROUP BY file_id, hour(t)
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY events DESC, peak_hour) = 1""")


def pattern_report(source: str, patterns: dict[str, str]) -> str:
    found = " UNION ALL ".join(
        f"""SELECT file_id, line_no, {q(kind)} AS kind, unnest(m) AS value, unnest(range(len(m))) AS pos
  FROM (SELECT file_id, line_no, regexp_extract_all(line, {q(rx)}, 0) AS m FROM {source})"""
        for kind, rx in patterns.items()
    )
    return f"""SELECT file_id, kind, rank, value, n, matches, distinct_values FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id, kind ORDER BY n DESC, f.line_no, f.pos) AS rank,
    sum(n) OVER (PARTITION BY file_id, kind)::BIGINT AS matches, count(*) OVER (PARTITION BY file_id, kind) AS distinct_values
  FROM (SELECT file_id, kind, value, count(*) AS n, min({{'line_no': line_no, 'pos': pos}}) AS f FROM ({found}) GROUP BY file_id, kind, value)) WHERE rank <= 5"""


put("extract_patterns", DOC_LINES, select=pattern_report("doc_lines", dims.EXTRACT_PATTERNS))
put("extract_patterns_logs", LOG, select=pattern_report("log_lines", dims.EXTRACT_PATTERNS))
put("extract_http_errors", DOC_LINES, select=pattern_report("doc_lines", {"error_code": dims.HTTP_ERROR_CODE}))

# --- retrieval -------------------------------------------------------------------------------------------------

CHUNKS = f"""chunks AS (SELECT file_id, i AS chunk_index, substring(text, i * {dims.CHUNK_STEP} + 1, {dims.CHUNK_CHARS}) AS text FROM (
  SELECT file_id, text, unnest(range((length(text) - 1) // {dims.CHUNK_STEP} + 1)) AS i FROM files WHERE length(text) > 0))"""
put("chunk_text", FILES, CHUNKS, select="SELECT file_id, chunk_index, length(text) AS chars, md5(text) AS text_md5 FROM chunks")
BODIES = "bodies AS (SELECT 'doc-' || doc_id AS file_id, CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END AS text FROM documents)"
put("chunk_lines", BODIES, CHUNKS.replace("FROM files", "FROM bodies"), select="SELECT file_id, chunk_index, length(text) AS chars, md5(text) AS text_md5 FROM chunks")
put("sample_lines", BODIES, select="""SELECT file_id, length(sample) AS chars, md5(sample) AS sample_md5 FROM (
  SELECT file_id, CASE WHEN length(text) > 3000 THEN left(text, 1500) || right(text, 1500) ELSE text END AS sample FROM bodies WHERE length(text) > 0)""")
INDEX = f"""docs AS (
  SELECT 'summaries' AS collection, 'summary_' || file_id AS id, file_id, path AS text, '-' AS level, '-' AS vuln_type, '-' AS severity, '-' AS category, '-' AS status, '-' AS reference_url, '-' AS timestamp FROM files
  UNION ALL SELECT 'chunks', 'chunk_' || file_id || '_' || chunk_index, file_id, text, '-', '-', '-', '-', '-', '-', '-' FROM chunks
  UNION ALL SELECT 'events', file_id || '_event_' || line_no || '_' || category_no, file_id, '[' || entry_type || '] ' || message, entry_type, '-', '-', '-', '-', '-', coalesce(logged_on, '') FROM resolved
  UNION ALL SELECT 'vulnerabilities', file_id || '_vuln_' || line_no || '_' || category_no, file_id, '[' || vuln_type || '] ' || message || chr(10) || 'Solution: ' || solution,
    '-', vuln_type, severity, '-', '-', reference_url, coalesce(logged_on, '') FROM resolved WHERE entry_type = 'Vulnerability'
  UNION ALL SELECT 'metadata', file_id || '_metadata', file_id, 'File: ' || original_filename || chr(10) || 'Category: ' || category || chr(10) || 'Summary: ' || summary || chr(10) || 'Status: ' || status,
    '-', '-', '-', category, status, '-', '-' FROM file_master)"""
put("index_docs", *RES, FILES, CHUNKS, MASTER, INDEX, select="""SELECT collection, id, file_id, level, vuln_type, severity, category, status, reference_url, timestamp,
  md5(text) AS text_md5 FROM docs""")
put("collection_stats", *RES, FILES, CHUNKS, MASTER, INDEX, select="SELECT collection, count(*) AS n FROM docs WHERE collection <> 'summaries' GROUP BY ALL")
put("collection_head", FILES, CHUNKS, select="""SELECT 'chunk_' || file_id || '_' || chunk_index AS id, file_id FROM chunks ORDER BY id LIMIT 5""")
put("upsert_docs", select="""SELECT 'chunks' AS collection, 'doc-' || d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN source ELSE 'quality ' || quality END AS text,
  CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS version FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
QUESTIONS = """questions AS (SELECT label::BIGINT AS query_id, list(m ORDER BY pos) AS qe FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label)"""


def nearest(score: str, k: int, where: str = "true") -> str:
    return f"""hits AS (SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, vec_id AS id, round({score}, 6) AS score FROM questions, embeddings WHERE {where})) WHERE rank <= {k})"""


COSINE = "list_cosine_similarity(qe, embedding::DOUBLE[])"
put("topk_similar", QUESTIONS, nearest(COSINE, 5), select="SELECT * FROM hits")
put("topk_similar_l2", QUESTIONS, nearest("-(list_distance(qe, embedding::DOUBLE[]) ** 2)", 10), select="SELECT * FROM hits")
put("topk_similar_where", QUESTIONS, nearest(COSINE, 5, "label = 3"), select="SELECT * FROM hits")
put("topk_similar_lsh", QUESTIONS, """size AS (SELECT greatest(1, least(48, CASE WHEN count(*) < 64 THEN 0 ELSE floor(log2(count(*) // 64))::INT + 1 END)) AS bits FROM embeddings)""",
    """rays AS (SELECT t, b, p, (((t + 1) * 7919 + (b + 1) * 104729 + ((p + 1) * (p + 3 * b + 5 * t + 7)) * 1299709) % 2003) / 1001.0::DOUBLE - 1 AS r
  FROM range(12) AS ts(t), range(48) AS bs(b), range((SELECT max(len(embedding)) FROM embeddings)) AS ps(p) WHERE b < (SELECT bits FROM size))""",
    """every AS (SELECT 0 AS kind, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT 1, query_id, qe FROM questions)""",
    """cells AS (SELECT kind, id, unnest(v) AS x, unnest(range(len(v))) AS p FROM every)""",
    """signs AS (SELECT kind, id, t, b, round(sum(x * r), 9) > 0 AS s FROM cells JOIN rays USING (p) GROUP BY kind, id, t, b)""",
    """codes AS (SELECT kind, id, t, sum(CASE WHEN s THEN 1::BIGINT << b ELSE 0 END) AS code FROM signs GROUP BY kind, id, t)""",
    """looks AS (SELECT id, t, code FROM codes WHERE kind = 1 UNION ALL SELECT id, t, xor(code::BIGINT, 1::BIGINT << b) FROM codes, range(48) AS bs(b) WHERE kind = 1 AND b < (SELECT bits FROM size))""",
    """met AS (SELECT DISTINCT q.id AS query_id, d.id FROM looks q JOIN codes d ON d.kind = 0 AND d.t = q.t AND d.code = q.code)""",
    """near AS (SELECT query_id, id, round(-(list_distance(qe, embedding::DOUBLE[]) ** 2), 6) AS score FROM met JOIN questions USING (query_id) JOIN embeddings ON vec_id = id)""",
    """found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 5)""",
    nearest("-(list_distance(qe, embedding::DOUBLE[]) ** 2)", 5),
    """shares AS (SELECT h.query_id, round(count(f.id) / count(*), 6) AS recall FROM hits h LEFT JOIN found f ON f.query_id = h.query_id AND f.id = h.id GROUP BY h.query_id)""",
    select="SELECT query_id, rank, id, score, recall FROM found JOIN shares USING (query_id)")
JOINED = nearest(COSINE, 3, "vec_id IN (SELECT doc_id FROM documents)")
put("retrieval_context", QUESTIONS, JOINED, select="""SELECT query_id, md5('=== Log File Summaries ===' || chr(10) || chr(10) ||
    string_agg('File: doc-' || doc_id || chr(10) || 'Summary: ' || source || ' ' || lang, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) ||
    '=== Relevant Log Details ===' || chr(10) || chr(10) ||
    string_agg('File: doc-' || doc_id || chr(10) || 'Content: ' || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5
  FROM hits JOIN documents ON id = doc_id GROUP BY query_id""")
put("search_report", QUESTIONS, nearest(COSINE, 5, "vec_id IN (SELECT doc_id FROM documents)"), select="""SELECT query_id,
  string_agg('File: doc-' || doc_id || chr(10) || 'Summary: ' || source || ' ' || lang, chr(10) || '---' || chr(10) ORDER BY rank) AS report
  FROM hits JOIN documents ON id = doc_id GROUP BY query_id""")
