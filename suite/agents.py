"""Agent traces, spans, stages, metric samples and evaluation suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.operators import evaluation
from quorumlens.session import scratch_path
from quorumlens.sources import sessions
from suite import bindings as b
from suite.bindings import sql_list
from suite.registry import register


@register(
    "metric_summary",
    """SELECT event_type AS name, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value) AS average,
         COUNT(value) AS samples FROM events GROUP BY 1""",
)
def metric_summary(spark, folder):
    samples = b.table(spark, folder, "events").select(
        F.col("event_type").alias("name"), F.col("value").cast("decimal(18,2)").alias("value")
    )
    return evaluation.metric_summary(samples)


@register(
    "metric_counters",
    """SELECT 'route_' || agent_name AS name, COUNT(*) AS total FROM traces GROUP BY 1
       UNION ALL SELECT 'route_all', COUNT(*) FROM traces""",
    "traces",
)
def metric_counters(spark, folder):
    routed = F.array(F.concat(F.lit("route_"), "agent_name"), F.lit("route_all"))
    increments = b.traces(spark, folder).select(F.explode(routed).alias("name"), F.lit(1).alias("amount"))
    return evaluation.counters(increments)


@register(
    "agent_latency",
    """SELECT 'latency_' || agent_name AS metric, COUNT(*) AS runs,
         CAST(SUM(duration_ms) AS DOUBLE) / COUNT(*) AS average_ms FROM traces GROUP BY 1
       UNION ALL SELECT 'latency_total', COUNT(*), CAST(SUM(duration_ms) AS DOUBLE) / COUNT(*) FROM traces""",
    "traces",
)
def agent_latency(spark, folder):
    return evaluation.agent_latency(b.traces(spark, folder))


@register(
    "session_rollup",
    """SELECT session_id, COUNT(*) AS n_traces, CAST(SUM(tokens_used) AS BIGINT) AS total_tokens,
         CAST(SUM(duration_ms) AS BIGINT) AS total_duration_ms,
         COUNT(DISTINCT CASE WHEN error IS NOT NULL THEN agent_name || ': ' || error END) AS distinct_errors
       FROM traces GROUP BY session_id""",
    "traces",
)
def session_rollup(spark, folder):
    return evaluation.session_rollup(b.traces(spark, folder))


@register(
    "session_errors",
    """SELECT DISTINCT session_id, agent_name || ': ' || error AS error FROM traces WHERE error IS NOT NULL""",
    "traces",
)
def session_errors(spark, folder):
    return evaluation.session_errors(b.traces(spark, folder))


_FLAGS = "flags AS (SELECT session_id, " + ", ".join(
    f"""COALESCE(MAX(CASE WHEN agent_name = '{s}' THEN CASE action WHEN 'completed' THEN 2 ELSE 1 END END), 0)
      AS {s}"""
    for s in fixed.STAGES
) + " FROM traces GROUP BY session_id)"


def session_documents(spark, folder):
    """One session document a conversation; ``conv`` is its number."""
    size = F.length("text")
    error = F.when(size % 7 == 0, F.concat(F.lit("code "), (size % 3).cast("string")))
    number = F.col("conv_id")
    at = F.timestamp_add("MINUTE", number.cast("int"), F.lit("2024-01-01").cast("timestamp"))
    trace = F.struct(
        F.col("role").alias("agent_name"),
        F.lit("completed").alias("action"),
        at.alias("timestamp"),
        size.cast("double").alias("duration_ms"),
        F.expr("length(text) div 4").cast("int").alias("tokens_used"),
        F.lit(None).cast("string").alias("input_summary"),
        F.lit(None).cast("string").alias("output_summary"),
        error.alias("error"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("details"),
    )
    rows = b.table(spark, folder, "conversations").groupBy(number.alias("conv"), at.alias("timestamp"))
    by_turn = lambda x, y: F.sign(x["turn"] - y["turn"]).cast("int")
    gathered = rows.agg(F.array_sort(F.collect_list(F.struct("turn", trace.alias("trace"))), by_turn).alias("turns"))
    traces = F.transform("turns", lambda t: t["trace"])
    texts = F.transform(F.filter(traces, lambda t: t["error"].isNotNull()), lambda t: F.concat(t["agent_name"], F.lit(": "), t["error"]))
    return gathered.select(
        "conv",
        F.concat(F.lit("s"), F.col("conv").cast("string")).alias("session_id"),
        F.concat(F.lit("question of "), F.col("conv").cast("string")).alias("question"),
        "timestamp",
        traces.alias("traces"),
        texts.alias("errors"),
    )


@register(
    "session_written",
    """SELECT strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id AS INT)), '%Y-%m-%d') AS date, role AS agent_name,
         'document' AS kind, COUNT(*) AS n, CAST(SUM(length(text)) AS DOUBLE) AS duration_ms, CAST(SUM(length(text) // 4) AS BIGINT) AS tokens
       FROM conversations GROUP BY 1, 2
       UNION ALL SELECT '2024-01-01', 'none', 'rejected', COUNT(DISTINCT conv_id), NULL, NULL FROM conversations WHERE conv_id % 5 = 0""",
)
def session_written(spark, folder):
    """Session documents written as JSON and read again, beside lines that are no documents."""
    path = scratch_path(spark, "sessions")
    documents = session_documents(spark, folder)
    sessions.write(documents.drop("conv"), path)
    torn = documents.filter("conv % 5 = 0").select(F.concat(F.lit('{"session_id": "'), "session_id", F.lit('", "traces": [{')).alias("line"))
    torn.write.mode("append").text(f"{path}/date=2024-01-01")
    good, rejected = sessions.read_checked(spark, path)
    flat = good.select("date", F.inline("traces"))
    read = flat.groupBy(F.col("date").cast("string").alias("date"), "agent_name").agg(
        F.lit("document").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms"), F.sum("tokens_used").alias("tokens")
    )
    left = rejected.filter(F.col("text").startswith('{"session_id"')).groupBy(F.col("date").cast("string").alias("date"), F.lit("none").alias("agent_name")).agg(
        F.lit("rejected").alias("kind"), F.count(F.lit(1)).alias("n")
    )
    return read.unionByName(left.withColumns({"duration_ms": F.lit(None).cast("double"), "tokens": F.lit(None).cast("bigint")}))


@register(
    "session_all_errors",
    """SELECT 's' || conv_id % 40 AS session_id, COUNT(DISTINCT conv_id) AS n_documents, array_to_string(list_sort(list_distinct(list(
         CASE WHEN length(text) % 7 = 0 THEN role || ': code ' || (length(text) % 3) END))), '|') AS errors
       FROM conversations GROUP BY 1 HAVING COUNT(*) FILTER (length(text) % 7 = 0) > 0
       UNION ALL SELECT 's' || conv_id % 40, COUNT(DISTINCT conv_id), '' FROM conversations GROUP BY 1
       HAVING COUNT(*) FILTER (length(text) % 7 = 0) = 0""",
)
def session_all_errors(spark, folder):
    """Errors of all documents of a session, each text once; forty sessions share the documents."""
    documents = session_documents(spark, folder).withColumn("session_id", F.concat(F.lit("s"), F.col("conv") % 40))
    found = sessions.errors_by_session(documents)
    return found.select("session_id", "n_documents", F.array_join("errors", "|").alias("errors"))


@register(
    "stage_status",
    f"WITH {_FLAGS} "
    + " UNION ALL ".join(
        f"""SELECT session_id, '{s}' AS stage, CASE {s} WHEN 2 THEN 'completed' WHEN 1 THEN 'started'
          ELSE 'not_run' END AS status FROM flags"""
        for s in fixed.STAGES
    ),
    "traces",
)
def stage_status(spark, folder):
    return evaluation.stage_status(b.traces(spark, folder))


@register(
    "stage_funnel",
    f"WITH {_FLAGS} SELECT CASE "
    + " ".join(f"WHEN {s} < 2 THEN '{s}'" for s in fixed.STAGES)
    + " ELSE 'end' END AS next_stage, COUNT(*) AS sessions FROM flags GROUP BY 1",
    "traces",
)
def stage_funnel(spark, folder):
    return evaluation.stage_funnel(b.traces(spark, folder))


@register(
    "stage_semi",
    """SELECT id AS session_id, question FROM query_log WHERE id IN
         (SELECT session_id FROM traces WHERE agent_name = 'sql_agent' AND action = 'completed')""",
    "query_log traces",
)
def stage_semi(spark, folder):
    sessions = b.query_log(spark, folder).select(F.col("id").alias("session_id"), "question")
    return evaluation.sessions_with_stage(sessions, b.traces(spark, folder), "sql_agent")


@register(
    "span_durations",
    """SELECT trace_id, span_id, name, CAST(end_ms - start_ms AS BIGINT) AS duration_ms FROM spans""",
    "spans",
)
def span_durations(spark, folder):
    timed = evaluation.span_durations(b.spans(spark, folder))
    return timed.select("trace_id", "span_id", "name", "duration_ms")


@register(
    "span_paths",
    """, walk AS (
         SELECT trace_id, span_id, name AS path, CAST(0 AS BIGINT) AS depth FROM spans WHERE parent_id IS NULL
         UNION ALL SELECT s.trace_id, s.span_id, w.path || '/' || s.name, w.depth + 1
         FROM walk w JOIN spans s ON s.trace_id = w.trace_id AND s.parent_id = w.span_id)
       SELECT trace_id, span_id, path, depth FROM walk""",
    "spans",
    recursive=True,
)
def span_paths(spark, folder):
    return evaluation.span_paths(b.spans(spark, folder))


@register(
    "trace_summary",
    """SELECT COUNT(*) AS traces, CAST(SUM(COALESCE(end_ms - start_ms, 0)) AS BIGINT) AS total_ms,
         CAST(SUM(COALESCE(end_ms - start_ms, 0)) AS DOUBLE) / COUNT(*) AS average_ms, COUNT(error) AS errors
       FROM spans WHERE parent_id IS NULL""",
    "spans",
)
def trace_summary(spark, folder):
    roots = b.spans(spark, folder).filter(F.col("parent_id").isNull())
    return evaluation.trace_summary(evaluation.span_durations(roots))


@register(
    "event_counts",
    """SELECT CAST(ts AS DATE) AS day, event_type AS action, COUNT(*) AS n FROM events GROUP BY 1, 2""",
)
def event_counts(spark, folder):
    rows = b.table(spark, folder, "events").withColumnRenamed("event_type", "action")
    return evaluation.counts_by_day(rows, "ts", "action")


# --- suites -------------------------------------------------------------------------------------------

#: Expectations per question template: agents that must run, words that must occur, refusal.
_EXPECTED = [
    (0, ["definition_agent", "sql_agent"], ["DIGITAL"], False),
    (1, list(fixed.STAGES), ["DIGITAL", "BRANCH"], False),
    (2, [], [], True),
    (5, ["definition_agent"], ["customer"], False),
    (99, ["definition_agent"], [], False),  # never ran
]

_EXPECTED_SQL = ", ".join(
    f"({c}, {sql_list(a)}::VARCHAR[], {sql_list(w)}::VARCHAR[], {str(r).lower()})"
    for c, a, w, r in _EXPECTED
)


@register(
    "eval_pass_rate",
    f"""WITH expected(case_id, agents, words, refuse) AS (VALUES {_EXPECTED_SQL}),
         results AS (SELECT CAST(k % 9 AS BIGINT) AS case_id, final_response AS response, k % 9 IN (2, 7) AS refused,
           {sql_list(fixed.STAGES)}[1:4 - LEAST(error_count, 3)] AS ran FROM query_log),
         judged AS (SELECT CASE WHEN refuse THEN refused ELSE NOT refused AND list_has_all(ran, agents)
             AND len(list_filter(words, lambda w: NOT contains(response, w))) = 0 END AS ok
           FROM expected LEFT JOIN results USING (case_id))
       SELECT COUNT(*) AS total, COUNT(*) FILTER (ok) AS passed, COUNT(*) FILTER (ok IS NOT TRUE) AS failed,
         CAST(round(CAST(COUNT(*) FILTER (ok) AS DOUBLE) * 100 / COUNT(*), 1) AS DOUBLE) AS pass_rate
       FROM judged""",
    "query_log",
)
def eval_pass_rate(spark, folder):
    k = F.col("k")
    stages = F.array(*[F.lit(s) for s in fixed.STAGES])
    results = b.query_log(spark, folder).select(
        (k % 9).cast("bigint").alias("case_id"),
        F.slice(stages, 1, 4 - F.least(F.col("error_count"), F.lit(3))).alias("agents"),
        F.col("final_response").alias("response"),
        (k % 9).isin(2, 7).alias("refused"),
    )
    expected = spark.createDataFrame(
        _EXPECTED,
        "case_id bigint, expected_agents array<string>, expected_contains array<string>, "
        "expected_out_of_scope boolean",
    )
    return evaluation.pass_rate(evaluation.judge(results, expected))


@register(
    "demo_verdict",
    """WITH d AS (SELECT CASE WHEN error_count > 2 THEN 'engine stopped' END AS error, k % 13 <> 0 AS scoped,
           k % 9 IN (2, 7) AS refuse, lower(final_response) AS r,
           CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS c FROM query_log)
       SELECT passed, reason, COUNT(*) AS n FROM (
         SELECT CASE WHEN error IS NOT NULL THEN 'Error: ' || error
             WHEN refuse THEN CASE WHEN NOT scoped THEN 'Correctly refused (privacy/safety)'
               WHEN r LIKE '%cannot%' OR r LIKE '%not allowed%' OR r LIKE '%privacy%' OR r LIKE '%refuse%'
                 OR r LIKE '%sorry%' THEN 'Query modified/refused for safety'
               ELSE 'Should have refused but executed' END
             WHEN NOT scoped THEN 'Incorrectly refused valid query'
             WHEN c IN ('high', 'medium') THEN 'Executed successfully (' || c || ' confidence)'
             ELSE 'Low confidence: ' || c END AS reason,
           error IS NULL AND CASE WHEN refuse THEN NOT scoped OR r LIKE '%cannot%' OR r LIKE '%not allowed%'
                 OR r LIKE '%privacy%' OR r LIKE '%refuse%' OR r LIKE '%sorry%'
             ELSE scoped AND c <> 'low' END AS passed
         FROM d) GROUP BY 1, 2""",
    "query_log",
)
def demo_verdict(spark, folder):
    k = F.col("k")
    demos = b.query_log(spark, folder).select(
        F.when(F.col("error_count") > 2, "engine stopped").alias("error"),
        (k % 13 != 0).alias("is_in_scope"),
        (k % 9).isin(2, 7).alias("should_refuse"),
        "final_response",
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"),
    )
    return evaluation.demo_tally(demos)
