"""The event table read as a stream, drained with an available-now trigger.

The streams are finite and end with a marker, so their results are those of the whole table. One query shows
a stream that goes on: windows that its watermark has not passed stay open.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens.session import scratch_path
from quorumlens.sources import log_table, sessions
from quorumlens.streaming import jobs
from suite import bindings as b
from suite.agents import session_documents
from suite.texts import INTENT, REDACTED_SQL, SCOPED
from suite.registry import register

DELAY = "10 minutes"


def _stream(spark, folder, name):
    schema = b.table(spark, folder, name).schema
    return jobs.read_files(spark, f"{folder}/{name}.parquet", schema)


def _events(spark, folder):
    events = _stream(spark, folder, "events")
    return events.withColumns(
        {"ts": F.col("ts").cast("timestamp"), "value": F.col("value").cast("decimal(18,2)")}
    )


def _times(df):
    """Window bounds as text, which has no time zone."""
    text = {
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        for c in ("window_start", "window_end")
        if c in df.columns
    }
    return df.withColumns(text)


@register(
    "stream_counters",
    """SELECT event_type AS name, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM events GROUP BY 1""",
)
def stream_counters(spark, folder):
    running = jobs.counters(_events(spark, folder), "event_type", "value")
    return jobs.drain(running, "counters", "complete").select(
        F.col("event_type").alias("name"), "n", "total"
    )


_CLOSED = f"(SELECT MAX(ts) - INTERVAL {DELAY} FROM events)"


def _ended(spark, folder):
    return jobs.ended(_events(spark, folder), "ts")


@register(
    "stream_windowed",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
         strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, COUNT(*) AS n,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM (SELECT date_trunc('hour', ts) AS w, event_type, value FROM events)
       GROUP BY w, event_type""",
)
def stream_windowed(spark, folder):
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    hourly = jobs.windowed(_ended(spark, folder), "ts", aggs, "1 hour", None, DELAY, ["event_type"])
    return _times(jobs.drain(hourly, "windowed"))


@register(
    "stream_open_windows",
    f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
         strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, COUNT(*) AS n,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM (SELECT date_trunc('hour', ts) AS w, event_type, value FROM events)
       WHERE w + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY w, event_type""",
)
def stream_open_windows(spark, folder):
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    hourly = jobs.windowed(_events(spark, folder), "ts", aggs, "1 hour", None, DELAY, ["event_type"])
    return _times(jobs.drain(hourly, "open_windows"))


@register(
    "stream_sliding",
    f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
         strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, COUNT(*) AS n
       FROM (SELECT unnest([h, h - INTERVAL 30 MINUTE]) AS w
             FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS h FROM events))
       GROUP BY w""",
)
def stream_sliding(spark, folder):
    counted = [F.count(F.lit(1)).alias("n")]
    sliding = jobs.windowed(_ended(spark, folder), "ts", counted, "1 hour", "30 minutes", DELAY)
    return _times(jobs.drain(sliding, "sliding"))


@register(
    "stream_sessions",
    f"""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER u <= INTERVAL 5 HOUR THEN 0 ELSE 1 END AS new
           FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
         grouped AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)
           AS session FROM marked)
       SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
         strftime(MAX(ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, COUNT(*) AS n
       FROM grouped GROUP BY user_id, session""",
)
def stream_sessions(spark, folder):
    counted = [F.count(F.lit(1)).alias("n")]
    found = jobs.sessions(_ended(spark, folder), "user_id", "ts", "5 hours", counted, DELAY)
    return _times(jobs.drain(found, "sessions"))


@register(
    "stream_pairing",
    f"""WITH s AS (SELECT event_id // 2 AS op, ts FROM events WHERE event_id % 2 = 0),
         e AS (SELECT event_id // 2 AS op, ts FROM events WHERE event_id % 2 = 1 AND event_type <> 'error')
       SELECT s.op, e.ts IS NOT NULL AS finished FROM s LEFT JOIN e
         ON s.op = e.op AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 5 MINUTE""",
)
def stream_pairing(spark, folder):
    operation = F.expr("event_id div 2").alias("op")
    events = _events(spark, folder)
    begun = events.filter(F.col("event_id") % 2 == 0)
    done = events.filter((F.col("event_id") % 2 == 1) & (F.col("event_type") != "error"))
    pairs = jobs.pair(
        jobs.ended(begun.select(operation, F.col("ts").alias("start_ts")), "start_ts", op=-1),
        jobs.ended(done.select(operation, F.col("ts").alias("end_ts")), "end_ts", op=-2),
        "op",
        "5 minutes",
        DELAY,
    )
    drained = jobs.drain(pairs, "pairing")
    return drained.select("op", F.col("end_ts").isNotNull().alias("finished"))


@register(
    "stream_redact",
    # the same text as the batch query: redaction has no state
    f"SELECT doc_id, {REDACTED_SQL} AS text FROM documents",
)
def stream_redact(spark, folder):
    documents = _stream(spark, folder, "documents").select("doc_id", "text")
    return jobs.drain(jobs.redact(documents, "text"), "redact")


_QUESTIONS = "(SELECT conv_id || '-' || turn AS id, text AS question, CAST(NULL AS TIMESTAMP) AS created_at FROM conversations WHERE role = 'user')"


@register(
    "stream_triage",
    f"""WITH {SCOPED.replace('FROM query_log', f'FROM {_QUESTIONS}')}
       SELECT id, status, reason, confidence, status <> 'out_of_scope' AS allowed, {INTENT} ELSE 'metric_query' END AS intent
       FROM verdicts JOIN (SELECT id, lower(question) AS q FROM {_QUESTIONS}) USING (id)""",
)
def stream_triage(spark, folder):
    """Scope and intent of the questions of a stream of conversations."""
    said = _stream(spark, folder, "conversations").filter("role = 'user'")
    questions = said.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"))
    return jobs.drain(jobs.classify(questions, "question").select("id", "scope.*", "intent"), "triage")


@register(
    "stream_log_merge",
    """SELECT 's' || conv_id AS id, 'question of ' || conv_id || CASE WHEN conv_id % 3 = 0 THEN ', again' ELSE '' END AS question,
         CAST(SUM(length(text)) AS DOUBLE) AS latency_ms, CAST(SUM(length(text) // 4) AS BIGINT) AS total_tokens,
         COUNT(DISTINCT CASE WHEN length(text) % 7 = 0 THEN role || ': code ' || (length(text) % 3) END) AS error_count,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id AS INT) + CASE WHEN conv_id % 3 = 0 THEN 7 ELSE 0 END), '%Y-%m-%d %H:%M') AS created
       FROM conversations GROUP BY conv_id""",
)
def stream_log_merge(spark, folder):
    """Session documents streamed into the log: all of them, some again, some in a newer form, and all once more by a new stream."""
    path = scratch_path(spark, "sessions")
    first = session_documents(spark, folder)
    again = first.filter("conv % 4 = 1")
    newer = first.filter("conv % 3 = 0").withColumns(
        {"question": F.concat("question", F.lit(", again")), "timestamp": F.col("timestamp") + F.expr("INTERVAL 7 MINUTES")}
    )
    log = log_table.LogTable(spark, scratch_path(spark, "log"), order=("created_at", "version"))
    sessions.write(first.drop("conv"), path)
    documents = jobs.read_sessions(spark, path, sessions.SESSION_DDL)
    jobs.merge_sessions(documents, log, "daily")
    sessions.write(newer.unionByName(again).drop("conv"), path)
    jobs.merge_sessions(documents, log, "daily")
    log.compact()
    jobs.merge_sessions(documents, log, "repeat")
    created = log_table.display_time(F.col("created_at")).alias("created")
    return log.read().select("id", "question", "latency_ms", "total_tokens", "error_count", created)


@register(
    "stream_k_anon",
    f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
         strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
         COUNT(DISTINCT user_id) AS entities, COUNT(*) AS n_events,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM (SELECT date_trunc('day', ts) AS w, event_type, user_id, value FROM events)
       GROUP BY w, event_type HAVING COUNT(DISTINCT user_id) >= 5""",
)
def stream_k_anon(spark, folder):
    safe = jobs.k_anon_stream(
        _ended(spark, folder), "ts", ["event_type"], "user_id", 5, "1 day", "value", DELAY
    )
    return _times(jobs.drain(safe, "k_anon"))
