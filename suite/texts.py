"""Triage of questions and SQL texts of the query log, personal data in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.functions import textguard
from quorumlens.operators import evaluation, triage
from quorumlens.plans.schema import EVENTS
from suite import bindings as b
from suite.bindings import sql_list, sql_text
from suite.registry import register


def _count_sql(words: list[str], text: str) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({text}, w)))"


SCOPED = f"""scoped AS (
  SELECT id, question, created_at, list_filter({sql_list(fixed.SCOPE_OUT_KEYWORDS)}, lambda w: contains(q, w))[1] AS off,
    {_count_sql(fixed.SCOPE_IN_KEYWORDS, 'q')} + {_count_sql(fixed.SCOPE_PATTERNS, 'q')} AS hits,
    len(list_filter({sql_list(fixed.SCOPE_INTERROGATIVES)}, lambda w: starts_with(q, w))) > 0 AS asks
  FROM (SELECT id, question, created_at, lower(question) AS q FROM query_log)),
verdicts AS (
  SELECT id, created_at,
    CASE WHEN off IS NOT NULL THEN 'out_of_scope' WHEN hits > 0 THEN 'in_scope' WHEN asks THEN 'unclear'
      ELSE 'out_of_scope' END AS status,
    CASE WHEN off IS NOT NULL THEN 'Question appears to be about ''' || off
        || ''', which is outside banking analytics scope.'
      WHEN hits >= 2 THEN {sql_text(fixed.SCOPE_REASONS['multiple'])}
      WHEN hits = 1 THEN {sql_text(fixed.SCOPE_REASONS['single'])}
      WHEN asks THEN {sql_text(fixed.SCOPE_REASONS['unclear'])}
      ELSE {sql_text(fixed.SCOPE_REASONS['rejected'])} END AS reason,
    CAST(CASE WHEN off IS NOT NULL THEN 0.9 WHEN hits >= 2 THEN 0.9 WHEN hits = 1 THEN 0.7
      WHEN asks THEN 0.5 ELSE 0.6 END AS DOUBLE) AS confidence
  FROM scoped)"""


@register(
    "scope_triage",
    f"WITH {SCOPED} SELECT id, status, reason, confidence, status <> 'out_of_scope' AS allowed FROM verdicts",
    "query_log",
)
def scope_triage(spark, folder):
    return triage.scope(b.query_log(spark, folder), "question").select("id", "scope.*")


@register(
    "scope_summary",
    f"""WITH {SCOPED} SELECT CAST(created_at AS DATE) AS day, status, COUNT(*) AS n
       FROM verdicts GROUP BY 1, 2""",
    "query_log",
)
def scope_summary(spark, folder):
    scoped = triage.scope(b.query_log(spark, folder), "question")
    return evaluation.counts_by_day(scoped, "created_at", F.col("scope.status").alias("status"))


INTENT = "CASE " + " ".join(
    f"WHEN {_count_sql(words, 'q')} > 0 THEN '{name}'" for name, words in fixed.INTENT_WORDS.items()
)


@register(
    "intent_classify",
    f"""SELECT id, {INTENT} ELSE 'metric_query' END AS intent
       FROM (SELECT id, lower(question) AS q FROM query_log)""",
    "query_log",
)
def intent_classify(spark, folder):
    return b.query_log(spark, folder).select(
        "id", textguard.intent(F.col("question")).alias("intent")
    )


_CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(sql_query, '(?m)--.*$', '', 'g'), "
    r"'(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))"
)


@register("sql_sanitize", f"SELECT id, {_CLEAN} AS clean FROM query_log", "query_log")
def sql_sanitize(spark, folder):
    return b.query_log(spark, folder).select(
        "id", textguard.sanitize(F.col("sql_query")).alias("clean")
    )


_IGNORED = sql_list([*fixed.SQL_NOT_COLUMNS, *EVENTS.names()])
_UNKNOWN = (
    r"list_sort(list_filter(list_distinct(regexp_extract_all(lower(sql_query), '\b([a-z_][a-z0-9_]*)\b', 1)), "
    f"lambda w: NOT list_contains({_IGNORED}, w) AND length(w) > 2 AND contains(w, '_')))"
)
# a line warns when its last SELECT has no LIMIT behind it
_NO_LIMIT = (
    r"len(list_filter(string_split(u, chr(10)), lambda l: regexp_matches(l, '\bSELECT\b') "
    r"AND NOT regexp_matches(regexp_replace(l, '^.*\bSELECT\b', ''), '\bLIMIT\b'))) > 0"
)
_CHECKED = rf"""checked AS (
  SELECT *, list_concat(
      CASE WHEN regexp_matches(u, 'SELECT\s+\*') THEN ['SELECT * may return more data than needed'] ELSE [] END,
      CASE WHEN {_NO_LIMIT} THEN ['Query has no LIMIT clause'] ELSE [] END,
      list_transform({_UNKNOWN}, lambda w: 'Possible invalid column reference: ''' || w || '''')) AS warned
  FROM (SELECT id, sql_query, created_at,
          upper(regexp_replace(sql_query, '^\s+|\s+$', '', 'g')) AS u FROM query_log))"""
_DANGER = " ".join(
    f"WHEN regexp_matches(u, {sql_text(p)}) THEN "
    + sql_text(f"Potentially dangerous SQL pattern detected: {text}")
    for p, text in fixed.SQL_DANGEROUS
)
_BLOCK = " ".join(
    rf"WHEN regexp_matches(u, '\b{w}\b') THEN 'Disallowed SQL operation: {w}. Only SELECT queries are permitted.'"
    for w in fixed.SQL_BLOCKED_WORDS
)
_VERDICTS = f"""{_CHECKED}, verdicts AS (
  SELECT id, created_at, sql_query, warned, CASE WHEN u = '' THEN 'Empty SQL query' {_BLOCK}
      WHEN NOT (starts_with(u, 'SELECT') OR starts_with(u, 'WITH'))
        THEN 'Query must start with SELECT or WITH. Got: ' || left(u, 20) || '...'
      {_DANGER} END AS refusal
  FROM checked)"""
_STATUS = "CASE WHEN refusal IS NOT NULL THEN 'invalid' WHEN len(warned) > 0 THEN 'warning' ELSE 'valid' END"


@register(
    "sql_verdict",
    f"""WITH {_VERDICTS}
       SELECT id, {_STATUS} AS status, COALESCE(refusal, CASE WHEN len(warned) > 0
         THEN 'Query is valid but has warnings' ELSE 'SQL query is valid' END) AS reason,
         refusal IS NULL AS allowed FROM verdicts""",
    "query_log",
)
def sql_verdict(spark, folder):
    return triage.sql(b.query_log(spark, folder), "sql_query").select("id", "verdict.*")


@register(
    "sql_warnings",
    f"WITH {_CHECKED} SELECT id, array_to_string(warned, '; ') AS warnings FROM checked",
    "query_log",
)
def sql_warnings(spark, folder):
    checked = triage.sql(b.query_log(spark, folder), "sql_query")
    return checked.select("id", F.array_join("warnings", "; ").alias("warnings"))


@register(
    "sql_unknown_columns",
    f"SELECT id, array_to_string({_UNKNOWN}, ',') AS unknown FROM query_log",
    "query_log",
)
def sql_unknown_columns(spark, folder):
    unknown = F.array_join(textguard.unknown_columns(F.col("sql_query")), ",")
    return b.query_log(spark, folder).select("id", unknown.alias("unknown"))


@register(
    "sql_add_limit",
    r"""SELECT id, CASE WHEN contains(upper(sql_query), 'LIMIT') THEN sql_query
         ELSE regexp_replace(regexp_replace(sql_query, '\s+$', ''), ';+$', '') || ' LIMIT 100' END AS limited
       FROM query_log""",
    "query_log",
)
def sql_add_limit(spark, folder):
    return b.query_log(spark, folder).select(
        "id", textguard.add_limit(F.col("sql_query"), 100).alias("limited")
    )


@register(
    "sql_validity_rate",
    f"""WITH {_VERDICTS}
       SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS sql_total,
         COUNT(*) FILTER (refusal IS NULL) AS sql_valid,
         CAST(COUNT(*) FILTER (refusal IS NULL) AS DOUBLE) / COUNT(*) AS validity_rate
       FROM verdicts GROUP BY 1""",
    "query_log",
)
def sql_validity_rate(spark, folder):
    return evaluation.sql_validity(b.query_log(spark, folder))


_PII = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(text, {sql_text(p)}) THEN 'Output may contain PII: {name}'"
        for p, name, _ in fixed.PII_PATTERNS
    )
    + " "
    + " ".join(
        f"WHEN regexp_matches(text, '(?i){w}') THEN 'Output may contain sensitive information: {w}'"
        for w in fixed.SENSITIVE_WORDS
    )
    + " ELSE 'Output is safe.' END"
)


@register(
    "pii_detect",
    f"SELECT doc_id, {_PII} = 'Output is safe.' AS safe, {_PII} AS reason FROM documents",
)
def pii_detect(spark, folder):
    return triage.pii(b.table(spark, folder, "documents"), "text").select("doc_id", "pii.*")


REDACTED_SQL = "text"
for _pattern, _, _label in fixed.PII_PATTERNS:
    REDACTED_SQL = f"regexp_replace({REDACTED_SQL}, {sql_text(_pattern)}, {sql_text(_label)}, 'g')"


@register("pii_redact", f"SELECT doc_id, {REDACTED_SQL} AS redacted FROM documents")
def pii_redact(spark, folder):
    return b.table(spark, folder, "documents").select(
        "doc_id", textguard.redact(F.col("text")).alias("redacted")
    )


@register(
    "pii_profile",
    f"""SELECT lang, source, COUNT(*) AS n, COUNT(*) FILTER (r <> 'Output is safe.') AS unsafe,
         COUNT(*) FILTER (starts_with(r, 'Output may contain PII')) AS pii
       FROM (SELECT lang, source, {_PII} AS r FROM documents) GROUP BY 1, 2""",
)
def pii_profile(spark, folder):
    checked = triage.pii(b.table(spark, folder, "documents"), "text")
    found = checked.select("lang", "source", F.col("pii.reason").alias("r"))
    return found.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("r") != "Output is safe.").alias("unsafe"),
        F.count_if(F.startswith("r", F.lit("Output may contain PII"))).alias("pii"),
    )
