"""The query log: writes, reads, scores, feedback and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.functions import scoring
from quorumlens.operators import evaluation
from quorumlens.sources import log_table
from suite import bindings as b
from suite.bindings import sql_list
from suite.registry import register

_CHANGES = """changes AS (
    SELECT id, question || ' again' AS question, created_at + INTERVAL 1 DAY AS created_at, user_score
    FROM query_log WHERE error_count > 0
    UNION ALL SELECT 'new' || id, question, created_at, user_score FROM query_log WHERE error_count > 1)"""


def _base(spark, folder):
    return b.query_log(spark, folder).select("id", "question", "created_at", "user_score")


def _changes(spark, folder):
    log = b.query_log(spark, folder).filter(F.col("error_count") > 0)
    edited = log.select(
        "id",
        F.concat("question", F.lit(" again")).alias("question"),
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
        "user_score",
    )
    added = log.filter(F.col("error_count") > 1).select(
        F.concat(F.lit("new"), "id").alias("id"), "question", "created_at", "user_score"
    )
    return edited.unionByName(added)


@register(
    "log_upsert",
    f"""WITH {_CHANGES}
       SELECT id, question, strftime(created_at, '%Y-%m-%d %H:%M') AS created,
         CAST(user_score AS BIGINT) AS user_score
       FROM (SELECT id, question, created_at, user_score FROM query_log WHERE id NOT IN (SELECT id FROM changes)
             UNION ALL SELECT * FROM changes)""",
    "query_log",
)
def log_upsert(spark, folder):
    merged = log_table.upsert(_base(spark, folder), _changes(spark, folder), "id", ["created_at"])
    created = log_table.display_time(F.col("created_at")).alias("created")
    return merged.select("id", "question", created, "user_score")


@register(
    "log_update",
    """SELECT l.id, CAST(CASE WHEN u.id IS NULL THEN l.user_score WHEN u.k % 2 = 0 THEN NULL ELSE 5 END AS BIGINT)
           AS user_score,
         CASE WHEN u.id IS NULL THEN l.user_feedback ELSE 'changed' END AS user_feedback
       FROM query_log l LEFT JOIN (SELECT id, k FROM query_log WHERE error_count > 0) u ON l.id = u.id""",
    "query_log",
)
def log_update(spark, folder):
    log = b.query_log(spark, folder)
    changes = log.filter(F.col("error_count") > 0).select(
        "id",
        F.when(F.col("k") % 2 == 1, 5).alias("user_score"),
        F.lit("changed").alias("user_feedback"),
        "created_at",
    )
    return log_table.update(
        log.select("id", "user_score", "user_feedback"),
        changes,
        "id",
        ["user_score", "user_feedback"],
        version="created_at",
    )


@register(
    "log_recent",
    """SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS shown FROM query_log
       ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""",
    "query_log",
)
def log_recent(spark, folder):
    page = log_table.recent(b.query_log(spark, folder), limit=20, offset=40)
    return page.select("id", log_table.display_time(F.col("created_at")).alias("shown"))


@register(
    "log_by_id",
    "SELECT id, question, sql_query FROM query_log WHERE id = 's77'",
    "query_log",
)
def log_by_id(spark, folder):
    found = log_table.by_id(b.query_log(spark, folder), "s77")
    return found.select("id", "question", "sql_query")


@register(
    "log_score_range",
    "SELECT id, self_score FROM query_log WHERE self_score >= 40 AND self_score <= 75",
    "query_log",
)
def log_score_range(spark, folder):
    return log_table.by_score(b.query_log(spark, folder), 40, 75).select("id", "self_score")


@register("log_unrated", "SELECT id, question FROM query_log WHERE user_score IS NULL", "query_log")
def log_unrated(spark, folder):
    return log_table.unrated(b.query_log(spark, folder), limit=None).select("id", "question")


@register(
    "log_tag_search",
    """SELECT id, tags, COALESCE(list_contains(string_split(tags, ','), 'fee'), false) AS exact
       FROM query_log WHERE tags ILIKE '%fee%'""",
    "query_log",
)
def log_tag_search(spark, folder):
    tags = F.col("tags")
    found = b.query_log(spark, folder).filter(log_table.has_tag(tags, "fee"))
    exact = log_table.has_tag(tags, "fee", exact=True).alias("exact")
    return found.select("id", "tags", exact)


@register(
    "result_summary",
    """WITH result AS (SELECT channel, COUNT(*) AS n FROM bank_events GROUP BY channel)
       SELECT (SELECT COUNT(*) FROM result) AS row_count, 'channel,n' AS columns,
         string_agg('{"channel":"' || channel || '","n":' || n || '}', chr(10) ORDER BY channel) AS sample
       FROM (SELECT * FROM result ORDER BY channel LIMIT 3)""",
    "bank_events",
)
def result_summary(spark, folder):
    counted = b.bank_events(spark, folder).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return log_table.result_summary(counted, ["channel"])


# --- self-evaluation ------------------------------------------------------------------------------------

_SCORED = """scored AS (
  SELECT *, CASE WHEN COALESCE(sql_query, '') = '' THEN 0 WHEN sql_explanation LIKE '%error%' THEN 50
      WHEN contains(upper(sql_query), 'SELECT') THEN 100 ELSE 50 END AS sql_valid,
    CASE WHEN NOT result_present THEN 0 WHEN result_success THEN 100 WHEN NOT result_success THEN 0
      WHEN result_error IS NOT NULL THEN 0 WHEN result_has_columns THEN 100 ELSE 50 END AS sql_executed,
    CASE WHEN NOT result_present THEN 0 WHEN row_count > 0 THEN 100
      WHEN contains(upper(sql_query), 'HAVING') AND contains(upper(sql_query), 'COUNT') THEN 50 ELSE 0 END
      AS has_data,
    CASE quality_status WHEN 'pass' THEN 100 WHEN 'warning' THEN 75 WHEN 'fail' THEN 25 ELSE 50 END
      AS quality_passed,
    CASE WHEN length(explanation_summary) > 20 THEN CASE WHEN insight_count > 0 THEN 100 ELSE 75 END
      WHEN explanation_summary IS NOT NULL THEN 50
      WHEN length(final_response) > 50 THEN CASE WHEN lower(final_response) LIKE '%error%'
        OR lower(final_response) LIKE '%could not%' THEN 25 ELSE 75 END
      ELSE 0 END AS explanation_present,
    CASE error_count WHEN 0 THEN 100 WHEN 1 THEN 50 WHEN 2 THEN 25 ELSE 0 END AS no_errors
  FROM query_log),
rated AS (SELECT *, (15 * sql_valid + 20 * sql_executed + 20 * has_data + 15 * quality_passed
    + 15 * explanation_present + 15 * no_errors) AS hundredths FROM scored),
judged AS (SELECT *, CASE WHEN hundredths >= 8000 THEN 'high' WHEN hundredths >= 5000 THEN 'medium'
    ELSE 'low' END AS confidence FROM rated)"""


@register(
    "self_eval_scores",
    f"""WITH {_SCORED} SELECT id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in scoring.COMPONENTS)}
       FROM scored""",
    "query_log",
)
def self_eval_scores(spark, folder):
    return evaluation.self_eval(b.query_log(spark, folder)).select("id", *scoring.COMPONENTS)


_ISSUES = ", ".join(
    f"CASE WHEN has_data = 50 THEN '{fixed.SELF_ISSUE_PRIVACY}' WHEN has_data < 100 THEN '{text}' END"
    if name == "has_data"
    else f"CASE WHEN {name} < 100 THEN '{text}' END"
    for name, text in fixed.SELF_ISSUES.items()
)


@register(
    "self_eval_overall",
    f"""WITH {_SCORED} SELECT id, CAST(hundredths AS DOUBLE) / 100 AS overall, confidence,
         concat_ws('; ', {_ISSUES}) AS issues FROM judged""",
    "query_log",
)
def self_eval_overall(spark, folder):
    scored = evaluation.self_eval(b.query_log(spark, folder))
    return scored.select("id", "overall", "confidence", F.array_join("issues", "; ").alias("issues"))


@register(
    "self_eval_stored",
    f"""WITH {_SCORED} SELECT id, CAST(CAST((hundredths + 5) // 10 AS DECIMAL(18,1)) / 10 + sql_valid
         + sql_executed + has_data + quality_passed + explanation_present + no_errors AS DOUBLE) / 7
         AS stored FROM rated""",
    "query_log",
)
def self_eval_stored(spark, folder):
    scored = evaluation.self_eval(b.query_log(spark, folder))
    return scored.select("id", F.col("stored_self_score").alias("stored"))


@register(
    "score_bands",
    f"""WITH {_SCORED} SELECT CAST(CASE WHEN hundredths >= 9000 THEN 5 WHEN hundredths >= 7000 THEN 4
         WHEN hundredths >= 5000 THEN 3 WHEN hundredths >= 3000 THEN 2 ELSE 1 END AS BIGINT) AS stars,
         COUNT(*) AS n FROM rated GROUP BY 1""",
    "query_log",
)
def score_bands(spark, folder):
    return evaluation.score_bands(evaluation.self_eval(b.query_log(spark, folder)))


@register(
    "confidence_distribution",
    f"""WITH {_SCORED} SELECT CAST(created_at AS DATE) AS day, confidence, COUNT(*) AS n
       FROM judged GROUP BY 1, 2""",
    "query_log",
)
def confidence_distribution(spark, folder):
    scored = evaluation.self_eval(b.query_log(spark, folder))
    return evaluation.counts_by_day(scored, "created_at", "confidence")


# --- feedback -------------------------------------------------------------------------------------------

_FEEDBACK = "CASE " + " ".join(
    f"WHEN list_contains({sql_list(words)}, lower(trim(feedback_word))) THEN {value}"
    for value, words in fixed.FEEDBACK_SCORES.items()
)


@register(
    "feedback_normalize",
    f"SELECT id, feedback_word, CAST({_FEEDBACK} END AS BIGINT) AS score FROM query_log",
    "query_log",
)
def feedback_normalize(spark, folder):
    score = scoring.feedback_score(F.col("feedback_word")).alias("score")
    return b.query_log(spark, folder).select("id", "feedback_word", score)


@register(
    "feedback_validate",
    """SELECT CASE WHEN error_count > 1 THEN 'gone' || id ELSE id END AS id, CAST(k % 7 AS BIGINT) AS score,
         CASE WHEN k % 7 NOT BETWEEN 1 AND 5 THEN 'invalid_score' WHEN error_count > 1 THEN 'unknown_session'
           ELSE 'saved' END AS outcome
       FROM query_log""",
    "query_log",
)
def feedback_validate(spark, folder):
    log = b.query_log(spark, folder)
    sent = log.select(
        F.when(F.col("error_count") > 1, F.concat(F.lit("gone"), "id")).otherwise(F.col("id"))
        .alias("id"),
        (F.col("k") % 7).alias("score"),
    )
    return log_table.feedback_intake(log, sent)


_STATS = """COUNT(*) AS total_queries,
    CAST(round(AVG(self_score), 2) AS DOUBLE) AS avg_self_score,
    CAST(round(AVG(user_score), 2) AS DOUBLE) AS avg_user_score,
    CAST(round(CAST(SUM(CAST(latency_ms AS DECIMAL(18,2))) AS DOUBLE) / COUNT(latency_ms), 2) AS DOUBLE)
      AS avg_latency_ms,
    CAST(round(AVG(total_tokens), 0) AS DOUBLE) AS avg_tokens,
    CAST(round(CAST(COUNT(*) FILTER (error_count > 0) AS DOUBLE) * 100 / COUNT(*), 1) AS DOUBLE) AS error_rate,
    CAST(round(CAST(COUNT(user_score) AS DOUBLE) * 100 / COUNT(*), 1) AS DOUBLE) AS rated_percentage"""


@register("log_stats", f"SELECT {_STATS} FROM query_log", "query_log")
def log_stats(spark, folder):
    return evaluation.stats(b.query_log(spark, folder))


_R = """(SELECT round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 3) AS r, n FROM
    (SELECT CAST(COUNT(*) AS DOUBLE) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * y) AS sxy, SUM(x * x) AS sxx,
       SUM(y * y) AS syy
     FROM (SELECT self_score AS x, CAST(user_score AS DOUBLE) AS y FROM query_log
           WHERE self_score IS NOT NULL AND user_score IS NOT NULL)))"""


@register(
    "score_correlation",
    f"""SELECT CAST(n AS BIGINT) AS n_pairs, r, CASE WHEN ABS(r) > 0.7 THEN 'strong'
         WHEN ABS(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS label FROM {_R}""",
    "query_log",
)
def score_correlation(spark, folder):
    return evaluation.correlation(b.query_log(spark, folder))


@register(
    "feedback_stats",
    f"""SELECT COUNT(*) AS total_queries, COUNT(user_score) AS rated_queries,
         COUNT(*) - COUNT(user_score) AS unrated_queries,
         CAST(round(CAST(COUNT(user_score) AS DOUBLE) * 100 / COUNT(*), 1) AS DOUBLE) AS feedback_rate,
         (SELECT r FROM {_R}) AS score_correlation FROM query_log""",
    "query_log",
)
def feedback_stats(spark, folder):
    return evaluation.feedback_stats(b.query_log(spark, folder))


@register(
    "improvement_insights",
    """WITH low AS (SELECT * FROM query_log WHERE user_score <= 2)
       SELECT COUNT(*) AS low_rated, COUNT(*) FILTER (error_count > 0) AS with_errors,
         COUNT(*) FILTER (row_count = 0) AS without_rows,
         (SELECT string_agg(user_feedback, '; ' ORDER BY created_at DESC) FROM
           (SELECT * FROM low WHERE user_feedback IS NOT NULL ORDER BY created_at DESC, id LIMIT 3)) AS themes
       FROM low""",
    "query_log",
)
def improvement_insights(spark, folder):
    return evaluation.improvement_insights(b.query_log(spark, folder))


@register(
    "route_outcome",
    """SELECT CASE WHEN error_count > 0 OR NOT result_present THEN 'stopped' ELSE 'audited' END AS outcome,
         COUNT(*) AS n FROM query_log GROUP BY 1""",
    "query_log",
)
def route_outcome(spark, folder):
    return evaluation.outcomes(b.query_log(spark, folder))
