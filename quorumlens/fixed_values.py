"""Word lists, patterns, weights and texts.

Fixed values: results are only right when these equal the values of the system whose answers are
matched, so they stand here together, as plain data and in their natural order.
"""

# --- question scope ---------------------------------------------------------------------------

SCOPE_IN_KEYWORDS = [
    "transaction", "deposit", "withdrawal", "payment", "transfer", "e-transfer", "etransfer",
    "balance", "amount", "total", "sum", "count", "average", "avg", "volume", "flow", "net",
    "channel", "digital", "branch", "call center", "batch", "online", "mobile",
    "customer", "account", "client",
    "chequing", "checking", "savings", "gic",
    "daily", "weekly", "monthly", "trend", "period", "date", "month", "year",
    "breakdown", "distribution", "top", "most", "least", "highest", "lowest",
    "fee", "interest", "event",
]

SCOPE_OUT_KEYWORDS = [
    "weather", "stock market", "news", "sports", "politics",
    "recipe", "movie", "music", "game", "joke",
    "remind", "alarm", "timer", "calendar",
    "translate", "define", "wikipedia",
    "write code", "debug", "compile", "programming",
]

SCOPE_PATTERNS = [
    "how many", "how much", "what is the",
    "show me", "list", "compare",
    "by month", "by channel", "by product",
    "last month", "this month", "year to date",
    "increase", "decrease", "growth", "change",
]

SCOPE_INTERROGATIVES = [
    "what", "how", "who", "when", "where", "why", "which", "show", "list", "get",
]

SCOPE_REASONS = {
    "multiple": "Question contains multiple analytics-related terms.",
    "single": "Question appears related to analytics.",
    "unclear": "Question type unclear. Proceeding with caution.",
    "rejected": (
        "Unable to determine if this is a banking analytics question. "
        "Please ask about transactions, deposits, withdrawals, or account data."
    ),
}

# --- question intent: first list with a hit wins ----------------------------------------------

INTENT_WORDS = {
    "trend": ["trend", "over time", "monthly", "weekly", "daily", "growth", "change"],
    "comparison": ["compare", "vs", "versus", "difference", "between"],
    "drill_down": ["breakdown", "by", "per", "each", "detail"],
    "data_exploration": ["show", "list", "what are", "explore"],
}
INTENT_DEFAULT = "metric_query"

# --- SQL text ---------------------------------------------------------------------------------

SQL_STARTS = ["SELECT", "WITH"]

SQL_BLOCKED_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER",
    "TRUNCATE", "GRANT", "REVOKE", "EXEC", "EXECUTE",
]

SQL_DANGEROUS = [
    (r";\s*(DROP|DELETE|INSERT|UPDATE|TRUNCATE)", "Multiple statements with dangerous operation"),
    (r"--\s*$", "SQL comment at end (potential injection)"),
    (r"/\*.*\*/", "Block comment (potential injection)"),
    (r"UNION\s+ALL\s+SELECT", "UNION injection pattern"),
    (r"OR\s+1\s*=\s*1", "Always-true condition (injection pattern)"),
    (r"'\s*OR\s+'", "String-based injection pattern"),
]

SQL_WARNINGS = [
    (r"SELECT\s+\*", "SELECT * may return more data than needed"),
    (r"(?<!LIMIT\s)(?<!TOP\s)\bSELECT\b(?!.*\bLIMIT\b)", "Query has no LIMIT clause"),
]

SQL_NOT_COLUMNS = [
    "select", "from", "where", "and", "or", "not", "in", "is", "null",
    "group", "by", "order", "asc", "desc", "limit", "offset", "having",
    "join", "left", "right", "inner", "outer", "on", "as", "distinct",
    "count", "sum", "avg", "min", "max", "round", "abs", "case", "when",
    "then", "else", "end", "between", "like", "true", "false", "cast",
    "events", "sample_events", "data", "csv", "with", "over", "partition",
    "strftime", "date", "filter", "coalesce", "nullif",
]

# --- personal data in output texts, in order of detection ---------------------------------------

PII_PATTERNS = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "Social Security Number pattern", "[SSN REDACTED]"),
    (r"\b\d{16}\b", "Credit card number pattern", "[CARD REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "Email address", "[EMAIL REDACTED]"),
]

SENSITIVE_WORDS = ["password", "secret", "api_key", "token"]

# --- feedback vocabulary ----------------------------------------------------------------------

FEEDBACK_SCORES = {
    1: ["1", "👎", "down", "no", "n", "-", "bad", "terrible", "wrong", "incorrect"],
    2: ["2", "poor", "not great", "could be better"],
    3: ["3", "ok", "okay", "fine", "meh", "neutral"],
    4: ["4", "decent", "alright", "acceptable"],
    5: ["5", "👍", "up", "yes", "y", "+", "good", "great", "excellent", "perfect"],
}

# --- self-evaluation --------------------------------------------------------------------------

SELF_WEIGHTS = {
    "sql_valid": "0.15",
    "sql_executed": "0.20",
    "has_data": "0.20",
    "quality_passed": "0.15",
    "explanation_present": "0.15",
    "no_errors": "0.15",
}

SELF_ISSUES = {
    "sql_valid": "SQL query had validation issues",
    "sql_executed": "SQL execution encountered errors",
    "has_data": "No data returned",
    "quality_passed": "Some data quality checks failed",
    "explanation_present": "Missing or incomplete explanation",
    "no_errors": "Pipeline errors occurred",
}
SELF_ISSUE_PRIVACY = "Query returned no data (may be due to privacy filtering)"

# --- pipeline stages and refusal words ----------------------------------------------------------

STAGES = ["definition_agent", "sql_agent", "data_quality_agent", "explanation_agent"]

REFUSAL_WORDS = ["cannot", "not allowed", "privacy", "refuse", "sorry"]

# --- columns whose values may be listed ---------------------------------------------------------

DISCOVERABLE_COLUMNS = ["event_type", "event_name", "channel", "product_type", "currency"]

# --- labels of the text chunks for retrieval ---------------------------------------------------

CHUNK_LABELS = {
    "product": "Product Term: ",
    "business": "Business Term: ",
    "definition": "Definition: ",
    "metric": "Metric: ",
    "category": "Category: ",
    "pattern": "SQL Pattern: ",
    "description": "Description: ",
    "example": "Example SQL: ",
    "rule": "Business Rule: ",
    "question": "Question Pattern: ",
    "filters": "Key Filters: ",
    "aggregation": "Aggregation: ",
    "table": "Table: ",
    "guidelines": "Query Guidelines for ",
    "grain": ":\n- Default time grain: ",
    "privacy": "\n- Privacy: k-anonymity minimum ",
    "identifiers": " accounts\n- No identifiers in output: ",
    "row_limit": "\n- Result row limit: ",
    "column": "Column: ",
    "type": "Type: ",
    "categorical": "Categorical: Yes",
    "allowed": "Possible values: ",
    "enum_value": "Enum Value: ",
    "meaning": "'\nMeaning: ",
    "enum": "Enum: ",
    "values": "Values: ",
    "note": "Schema Note: ",
}
