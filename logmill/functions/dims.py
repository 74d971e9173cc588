"""Fixed values of the product: categories, patterns, word lists, texts.

Everything here is a constant of known size, so it enters plans as literals
(array, map or regex literals) and never as a table that could grow.
"""

from __future__ import annotations

# --- Fixed values: folders and domains -----------------------------------

LOG_CATEGORIES = ["agreement", "app_log", "system_log", "governance_log", "unstructured_log"]

DOCUMENT_TYPES = ["cv", "resume", "invoice", "report", "contract"]

# In priority order: on equal scores the first one wins.
DOMAIN_KEYWORDS = {
    "agreement": ["contract", "signed", "nda", "terms", "agreement"],
    "system_log": ["cpu", "disk", "kernel", "boot", "service", "windows", "linux", "server"],
    "app_log": ["login", "http", "api", "json", "exception", "stacktrace", "request", "response"],
    "governance_log": ["audit", "policy", "compliance", "gdpr", "security", "access"],
}

# --- Fixed values: attack signatures (matched without regard to case) ----

ATTACK_PATTERNS = {
    "SQL Injection (SQLi)": [
        r"UNION\s+SELECT", r"OR\s+1=1", r"DROP\s+TABLE", r"--",
        r"OR\s+'1'='1'", r"SELECT\s+\*\s+FROM", r"WaitForDelay", r"pg_sleep",
    ],
    "Cross-Site Scripting (XSS)": [
        r"<script>", r"javascript:", r"onerror=", r"onload=",
        r"alert\(", r"document\.cookie", r'"><img src=x',
    ],
    "Path Traversal (LFI/RFI)": [
        r"\.\./", r"\.\.\\", r"/etc/passwd", r"c:\\windows\\system32", r"boot\.ini", r"win\.ini",
    ],
    "Brute Force / Auth Failure": [
        r"Failed password", r"authentication failure", r"invalid user",
        r"Too many authentication failures", r"Brute check",
    ],
    "Command Injection": [
        r";\s*cat\s+", r"\|\s*nc\s+", r"\|\s*bash", r"&&\s*wget", r"&&\s*curl",
    ],
}

# --- Fixed values: level words and time shapes ----------------------------

ERROR_WORDS = ["ERROR", "CRITICAL", "FATAL", "FAIL", "FAILED", "EXCEPTION"]
WARNING_WORDS = ["WARN", "WARNING"]
LINE_TIME = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"

# name -> (regex, Spark datetime pattern); "syslog" has no year of its own.
TIME_SHAPES = {
    "iso": (r"\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    "iso_t": (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
    "syslog": (r"[A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}", "yyyy MMM d HH:mm:ss"),
    "common": (r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}", "dd/MMM/yyyy:HH:mm:ss"),
}

# --- Fixed values: things to extract from text ------------------------------

EXTRACT_PATTERNS = {
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "url": r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[^\s]*",
}
HTTP_ERROR_CODE = r"\b[45]\d{2}\b"

# --- Fixed values: file classifier -------------------------------------------

FAST_PATH_WORDS = ["INFO", "DEBUG", "ERROR", "WARN"]

# In priority order: on equal scores the first one wins.
CLASS_KEYWORDS = {
    "log": [
        "error", "warning", "info", "debug", "exception", "stacktrace",
        "timestamp", "kernel", "system", "service",
        "src_ip", "dst_ip", "source ip", "destination ip", "protocol", "packet",
        "src ip", "dst ip", "proto", "flags", "duration", "bytes",
        "user_id", "session_id", "access_log", "auth_failed",
    ],
    "cv": ["curriculum vitae", "education", "work experience", "skills",
           "professional summary", "employment history", "qualifications"],
    "resume": ["resume", "objective", "career summary", "references available"],
    "invoice": ["invoice", "bill", "payment", "amount due", "total", "tax"],
}

CLASSIFIER_LABELS = [
    "log file", "system log", "error log", "application log", "network log", "security log",
    "server log", "audit log", "curriculum vitae", "resume", "invoice", "financial report",
    "technical report", "legal contract", "agreement", "other document",
]

LOG_COLUMN_WORDS = ["timestamp", "date", "time", "level", "severity", "msg", "message",
                    "src ip", "dst ip", "source", "destination", "proto", "protocol", "ip"]

LOG_EVIDENCE = ["info", "debug", "error", "warn", "critical", "traceback", "exception",
                "timestamp", "kernel", "level=", "msg=", "time=", "date="]

STRUCTURED_EXTENSIONS = ["csv", "xlsx", "xls", "parquet"]
TEXT_EXTENSIONS = ["txt", "log", "pdf"]
ROUTED_DOCUMENT_TYPES = ["cv", "resume", "invoice", "report", "contract", "other_document"]

UUID_PATTERN = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

# --- Fixed values: resolutions: type -> (severity, summary, solution, url) ---

FIXED_RESOLUTIONS = {
    "SQL Injection (SQLi)": (
        "High",
        "Use parameterized queries or prepared statements.",
        "Use parameterized queries or prepared statements. Never concatenate user input directly "
        "into SQL queries. Implement input validation and use ORM frameworks.",
        "https://owasp.org/www-community/attacks/SQL_Injection",
    ),
    "Cross-Site Scripting (XSS)": (
        "High",
        "Sanitize all user input and use CSP.",
        "Sanitize all user input. Use Content Security Policy (CSP). Encode output data. "
        "Validate input on both client and server side.",
        "https://owasp.org/www-community/attacks/xss/",
    ),
    "Path Traversal (LFI/RFI)": (
        "High",
        "Validate and sanitize file paths.",
        "Validate and sanitize file paths. Use whitelisting for allowed files. Avoid using user "
        "input directly in file operations. Implement proper access controls.",
        "https://owasp.org/www-community/attacks/Path_Traversal",
    ),
    "Brute Force / Auth Failure": (
        "Medium",
        "Implement rate limiting and account lockout.",
        "Implement rate limiting. Use account lockout mechanisms. Enable multi-factor "
        "authentication. Monitor failed login attempts. Use CAPTCHA after multiple failures.",
        "https://owasp.org/www-community/controls/Blocking_Brute_Force_Attacks",
    ),
    "Command Injection": (
        "High",
        "Avoid using shell commands with user input.",
        "Avoid using shell commands with user input. Use language-specific APIs instead. "
        "Implement strict input validation. Use whitelisting for allowed commands.",
        "https://owasp.org/www-community/attacks/Command_Injection",
    ),
}
DEFAULT_RESOLUTION = (
    "Medium",
    "Review the log entry and apply security best practices.",
    "Review the log entry and apply security best practices. Consult OWASP guidelines for "
    "specific vulnerability type.",
    "https://owasp.org/www-project-top-ten/",
)
SEARCH_URL = "https://google.com/search?q="
ANSWER_DEFAULT_SOLUTION = "Review and sanitize input."
#: Severity, summary, solution and address for an incident whose model call failed.
FAILED_CALL_RESOLUTION = ("High", "", "Manual investigation required.", "")

# --- Fixed values: stop words ----------------------------------------------------

# Words a summary keyword may not consist of.
SUMMARY_STOP_WORDS = [
    "info", "debug", "trace", "warn", "date", "time", "timestamp", "log", "file", "path",
    "message", "level", "thread", "class", "start", "end", "completed", "running", "process",
    "server",
]
# Words that may not become a category name.
CATEGORY_STOP_WORDS = [
    "total", "entries", "keywords", "summary", "unknown", "file", "log", "data", "text",
    "error", "info", "warn", "fail", "failed", "sample",
]
# Added to the English list when lines are vectorised.
LINE_STOP_WORDS = ["info", "error", "warn", "timestamp", "at", "failed"]

# The words of Spark's StopWordsRemover list for English that a token of two or
# more word characters can equal (contractions and single letters left out).
ENGLISH_STOP_WORDS = (
    "about above after again against all am an and any are as at be because been before being "
    "below between both but by can cannot could did do does doing don down during each few for "
    "from further had has have having he her here hers herself him himself his how if in into is "
    "it its itself just me more most my myself no nor not now of off on once only or other ought "
    "our ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()

# --- Fixed values: limits -----------------------------------------------------------

MESSAGE_CHARS = 1000
FINDING_CHARS = 200
DEDUPE_CHARS = 200
SIGNATURE_CHARS = 100
FAST_PATH_CHARS = 1000
CLASSIFY_CHARS = 2000
MAX_TERMS = 500
TOP_KEYWORDS = 30
CHUNK_CHARS = 1000
CHUNK_STEP = 900
HEAD_CHARS = 200
LISTING_ROWS = 100
SAMPLE_CHARS = 50_000
TABLE_ROWS = 1000
