"""Triage of questions, SQL texts and outputs as native column expressions.

Every rule is one expression over the whole text of a column, so it runs inside code generation, in
batch and in streams alike. Character classes follow ASCII rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.plans.schema import EVENTS


def _first_match(choices: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first true condition, in order."""
    (condition, value), *rest = choices
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def _any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _count_of(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur at least once."""
    n = F.lit(0)
    for word in words:
        n = n + F.contains(text, F.lit(word)).cast("int")
    return n


# --- questions ----------------------------------------------------------------------------------


def off_topic(lower: Column) -> Column:
    """First off-topic word, in list order, of a question in lower case."""
    return F.coalesce(
        *[F.when(F.contains(lower, F.lit(word)), word) for word in fixed.SCOPE_OUT_KEYWORDS]
    )


def analytics_hits(lower: Column) -> Column:
    return _count_of(lower, fixed.SCOPE_IN_KEYWORDS) + _count_of(lower, fixed.SCOPE_PATTERNS)


def asks(lower: Column) -> Column:
    """Whether a question starts with an interrogative."""
    hit = F.lit(False)
    for word in fixed.SCOPE_INTERROGATIVES:
        hit = hit | F.startswith(lower, F.lit(word))
    return hit


def scope(off: Column, hits: Column, asking: Column) -> Column:
    """struct(status, reason, confidence, allowed) from the three findings above."""
    about = F.concat(
        F.lit("Question appears to be about '"),
        off,
        F.lit("', which is outside banking analytics scope."),
    )

    def verdict(status: str, reason: Column, confidence: float) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            reason.alias("reason"),
            F.lit(confidence).alias("confidence"),
            F.lit(status != "out_of_scope").alias("allowed"),
        )

    reasons = {key: F.lit(text) for key, text in fixed.SCOPE_REASONS.items()}
    return _first_match(
        [
            (off.isNotNull(), verdict("out_of_scope", about, 0.9)),
            (hits >= 2, verdict("in_scope", reasons["multiple"], 0.9)),
            (hits == 1, verdict("in_scope", reasons["single"], 0.7)),
            (asking, verdict("unclear", reasons["unclear"], 0.5)),
        ],
        verdict("out_of_scope", reasons["rejected"], 0.6),
    )


def intent(question: Column) -> Column:
    """Intent of a question: the first word list with a hit wins."""
    q = F.lower(question)
    choices = [(_any_of(q, words), F.lit(name)) for name, words in fixed.INTENT_WORDS.items()]
    return _first_match(choices, F.lit(fixed.INTENT_DEFAULT))


# --- SQL texts ----------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: A piece of text without which the dangerous pattern at the same position cannot match.
_NEEDED = [";", "--", "/*", "UNION", "OR", "'"]


def _has(text: Column, pattern: str, needed: str | None = None) -> Column:
    """Pattern search where only a newline ends a line; a plain substring test comes first."""
    found = text.rlike("(?d)" + pattern)
    return found if needed is None else F.contains(text, F.lit(needed)) & found


def sanitize(sql: Column) -> Column:
    """SQL without comments, with each run of white space replaced by one blank."""
    no_line_comments = F.regexp_replace(sql, r"(?md)--.*$", "")
    no_comments = F.regexp_replace(no_line_comments, r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(no_comments, r"\s+", " "))


def unknown_columns(sql: Column, known: Sequence[str] = EVENTS.names()) -> Column:
    """Sorted words with an underscore that are neither keywords nor columns of the table."""
    words = F.regexp_extract_all(F.lower(sql), F.lit(r"\b([a-z_][a-z0-9_]*)\b"), F.lit(1))
    ignored = [*fixed.SQL_NOT_COLUMNS, *known]
    unknown = F.filter(
        words, lambda w: F.contains(w, F.lit("_")) & (F.length(w) > 2) & ~w.isin(ignored)
    )
    return F.array_sort(F.array_distinct(unknown))


def warnings(upper: Column, unknown: Column) -> Column:
    """Warnings of an acceptable query from its stripped upper-case text and its unknown columns."""
    general = F.array(*[F.when(_has(upper, p), F.lit(t)) for p, t in fixed.SQL_WARNINGS])
    columns = F.transform(
        unknown, lambda w: F.concat(F.lit("Possible invalid column reference: '"), w, F.lit("'"))
    )
    return F.concat(F.array_compact(general), columns)


def refusal(upper: Column, strict: bool = False) -> Column:
    """Reason of the first failing rule of a stripped upper-case SQL text; NULL when none fails.

    ``strict`` also blocks MERGE, which the written policy forbids but the word list leaves out.
    """
    rules = [(upper == "", F.lit("Empty SQL query"))]
    for word in fixed.SQL_BLOCKED_WORDS + (["MERGE"] if strict else []):
        text = f"Disallowed SQL operation: {word}. Only SELECT queries are permitted."
        rules.append((_has(upper, rf"\b{word}\b", word), F.lit(text)))
    starts = F.lit(False)
    for word in fixed.SQL_STARTS:
        starts = starts | F.startswith(upper, F.lit(word))
    got = F.concat(
        F.lit("Query must start with SELECT or WITH. Got: "), F.left(upper, F.lit(20)), F.lit("...")
    )
    rules.append((~starts, got))
    for (pattern, description), needed in zip(fixed.SQL_DANGEROUS, _NEEDED, strict=True):
        text = f"Potentially dangerous SQL pattern detected: {description}"
        rules.append((_has(upper, pattern, needed), F.lit(text)))
    return _first_match(rules, F.lit(None).cast("string"))


def verdict(refused: Column, warned: Column) -> Column:
    """struct(status, reason, allowed) from the refusal and the list of warnings."""

    def outcome(status: str, reason: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            reason.alias("reason"),
            F.lit(status != "invalid").alias("allowed"),
        )

    return _first_match(
        [
            (refused.isNotNull(), outcome("invalid", refused)),
            (F.size(warned) > 0, outcome("warning", F.lit("Query is valid but has warnings"))),
        ],
        outcome("valid", F.lit("SQL query is valid")),
    )


def add_limit(sql: Column, n: int = 1000) -> Column:
    """Append LIMIT when the text does not contain the word; a column named credit_limit counts too."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"\s+$", ""), r";+$", "")
    missing = ~F.contains(F.upper(sql), F.lit("LIMIT"))
    return F.when(missing, F.concat(bare, F.lit(f" LIMIT {n}"))).otherwise(sql)


# --- outputs ------------------------------------------------------------------------------------

#: Position of the e-mail rule, the only pattern whose search cost depends on long word runs.
_EMAIL = 2


def _may_match(text: Column, position: int) -> Column:
    """Cheap test that a pattern can match at all; skips the costly search on most texts."""
    return F.contains(text, F.lit("@")) if position == _EMAIL else F.lit(True)


def pii(text: Column, lower: Column) -> Column:
    """struct(safe, reason): the first personal-data pattern or sensitive word found in a text."""

    def outcome(safe: bool, reason: str) -> Column:
        return F.struct(F.lit(safe).alias("safe"), F.lit(reason).alias("reason"))

    rules = [(text.isNull(), outcome(True, "Output is empty (None)"))]
    for i, (pattern, name, _) in enumerate(fixed.PII_PATTERNS):
        found = _may_match(text, i) & text.rlike(pattern)
        rules.append((found, outcome(False, f"Output may contain PII: {name}")))
    for word in fixed.SENSITIVE_WORDS:
        reason = f"Output may contain sensitive information: {word}"
        rules.append((F.contains(lower, F.lit(word)), outcome(False, reason)))
    return _first_match(rules, outcome(True, "Output is safe."))


def redact(text: Column) -> Column:
    """Text with every personal-data match replaced, whatever its length."""
    for i, (pattern, _, replacement) in enumerate(fixed.PII_PATTERNS):
        replaced = F.regexp_replace(text, pattern, replacement)
        text = F.when(_may_match(text, i), replaced).otherwise(text) if i == _EMAIL else replaced
    return text


def truncate(text: Column, n: int) -> Column:
    """Text cut to ``n`` characters with '...' when it is longer."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def json_from_text(text: Column) -> Column:
    """The JSON document in a text, from its fenced block if it has one; NULL when it does not parse."""
    # without a closing fence the block ends before the last character
    tagged = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|.\z)", 1)
    plain = F.regexp_extract(text, r"(?s)```(.*?)(?:```|.\z)", 1)
    body = (
        F.when(F.contains(text, F.lit("```json")), tagged)
        .when(F.contains(text, F.lit("```")), plain)
        .otherwise(text)
    )
    return F.try_parse_json(strip(body))
