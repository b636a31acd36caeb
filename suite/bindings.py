"""The given tables in the roles of the engine's tables, on Spark and as SQL.

``bank_orders`` and ``bank_events`` are event tables, ``query_log`` a log of questions, ``traces`` the
agent traces of its sessions, ``spans`` a span tree, ``docs`` a vector collection and ``centroids`` its
queries. Each view is derived row by row from one given table (``centroids`` by an aggregate), so it
grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.functions import vectors

CHANNELS = ["DIGITAL", "BRANCH", "CALL_CENTER", "BATCH"]
PRODUCTS = ["CHEQUING", "SAVINGS", "GIC"]

QUESTIONS = [
    "Show the monthly trend of money out of savings",
    "Compare branch and digital deposits",
    "How is the weather in the city",
    "Hello there",
    "Which one",
    "Breakdown of fee income per branch",
    "Balance of each client",
    "Tell a joke about account fees",
    "list values",
]

SQL_TEXTS = [
    "SELECT channel, COUNT(*) AS n FROM events GROUP BY channel LIMIT 10",
    "SELECT * FROM events",
    "DELETE FROM events",
    "SELECT channel FROM events; DROP TABLE users",
    "SELECT channel FROM events -- all rows\nWHERE channel = 'BRANCH' LIMIT 5",
    "SELECT channel FROM events /* note\nover lines */ LIMIT 5",
    "SELECT channel FROM a UNION ALL SELECT channel FROM b LIMIT 3",
    "SELECT channel,\n  SUM(event_amount) AS total\nFROM events\nGROUP BY channel\nLIMIT 20",
    "SELECT credit_limit FROM events",
    "WITH m AS (SELECT event_date FROM events) SELECT event_date FROM m LIMIT 7",
    "SELECT channel FROM events WHERE 1=1 OR 1 = 1 LIMIT 5",
    "  ",
    "SELECT wrong_column, event_name FROM events LIMIT 4;",
    "SELECT channel FROM events GROUP BY channel HAVING COUNT(DISTINCT account_id) >= 5",
    "MERGE INTO events USING x ON true",
    "SELECT channel FROM events WHERE note = 'drop' LIMIT 5",
]

TAGS = ["coffee,fee", "fee", "trend,channel", "Fees", "branch"]

FEEDBACK_WORDS = ["Great", " 👍 ", "no", "OK", "decent", "not great", "3", "7", "perhaps", "-"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """Element of a list by an index column, which runs from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_pick(values: list[str], index: str) -> str:
    return f"list_extract({sql_list(values)}, CAST({index} AS BIGINT) + 1)"


# --- bank_orders ------------------------------------------------------------------------------------


def bank_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    third = key % 3 == 0
    price = F.col("o_totalprice").cast("decimal(18,2)")
    name = (
        F.when(status == "P", "monthly_fee")
        .when((status == "O") & third, "transfer_in")
        .when(status == "O", "deposit")
        .when(third, "payment")
        .otherwise("withdrawal")
    )
    return orders.select(
        key.alias("event_id"),
        F.col("o_orderdate").alias("event_ts"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("o_custkey").alias("account_id"),
        F.expr("o_custkey div 5").alias("customer_id"),
        F.col("o_orderpriority").alias("product_type"),
        F.when(status == "P", "fee").otherwise("money_movement").alias("event_type"),
        name.alias("event_name"),
        pick(CHANNELS, key % 4).alias("channel"),
        F.when(status == "O", price).otherwise((-price).cast("decimal(18,2)")).alias("event_amount"),
        F.lit("CAD").alias("currency"),
    )


BANK_ORDERS = f"""
  SELECT o_orderkey AS event_id, o_orderdate AS event_ts, CAST(o_orderdate AS DATE) AS event_date,
    o_custkey AS account_id, o_custkey // 5 AS customer_id, o_orderpriority AS product_type,
    CASE WHEN o_orderstatus = 'P' THEN 'fee' ELSE 'money_movement' END AS event_type,
    CASE WHEN o_orderstatus = 'P' THEN 'monthly_fee'
      WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'transfer_in' ELSE 'deposit' END
      WHEN o_orderkey % 3 = 0 THEN 'payment' ELSE 'withdrawal' END AS event_name,
    {sql_pick(CHANNELS, 'o_orderkey % 4')} AS channel,
    CAST(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2))
      AS event_amount,
    'CAD' AS currency
  FROM orders"""


# --- bank_events ------------------------------------------------------------------------------------


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"


def bank_events(spark: SparkSession, folder: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    value = F.col("value").cast("decimal(18,2)")
    amount = (
        F.when(kind == "signup", F.lit(None))
        .when(kind.isin("purchase", "error"), (-value).cast("decimal(18,2)"))
        .otherwise(value)
    )
    name = (
        F.when(kind == "click", "deposit")
        .when((kind == "view") & (k % 10 == 0), "transfer_out")
        .when(kind == "view", "transfer_in")
        .when(kind == "purchase", "withdrawal")
        .when(kind == "error", "monthly_fee")
        .otherwise("account_opened")
    )
    role = (
        F.when(kind == "error", "fee").when(kind == "signup", "account_status")
        .otherwise("money_movement")
    )
    return (
        table(spark, folder, "events")
        .withColumn("k", _k())
        .select(
            "event_id",
            F.col("ts").cast("timestamp").alias("event_ts"),
            F.col("ts").cast("date").alias("event_date"),
            F.col("user_id").alias("account_id"),
            F.expr("user_id div 3").alias("customer_id"),
            pick(PRODUCTS, k % 3).alias("product_type"),
            role.alias("event_type"),
            name.alias("event_name"),
            F.when(k == 7, "KIOSK").otherwise(pick(CHANNELS, k % 4)).alias("channel"),
            amount.cast("decimal(18,2)").alias("event_amount"),
            F.lit("CAD").alias("currency"),
            (k % 3).cast("decimal(18,2)").alias("balance_after"),
            "k",
        )
    )


BANK_EVENTS = f"""
  SELECT event_id, ts AS event_ts, CAST(ts AS DATE) AS event_date, user_id AS account_id,
    user_id // 3 AS customer_id, {sql_pick(PRODUCTS, 'k % 3')} AS product_type,
    CASE e WHEN 'error' THEN 'fee' WHEN 'signup' THEN 'account_status' ELSE 'money_movement' END
      AS event_type,
    CASE e WHEN 'click' THEN 'deposit'
      WHEN 'view' THEN CASE WHEN k % 10 = 0 THEN 'transfer_out' ELSE 'transfer_in' END
      WHEN 'purchase' THEN 'withdrawal' WHEN 'error' THEN 'monthly_fee' ELSE 'account_opened' END
      AS event_name,
    CASE WHEN k = 7 THEN 'KIOSK' ELSE {sql_pick(CHANNELS, 'k % 4')} END AS channel,
    CAST(CASE WHEN e = 'signup' THEN NULL WHEN e IN ('purchase', 'error') THEN -value ELSE value END
      AS DECIMAL(18,2)) AS event_amount,
    'CAD' AS currency, CAST(k % 3 AS DECIMAL(18,2)) AS balance_after, k
  FROM (SELECT event_id, ts, user_id, value, event_type AS e, {_K} AS k FROM events)"""


# --- query_log --------------------------------------------------------------------------------------


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    k, n = F.col("k"), F.col("event_id")
    failed = F.col("event_type") == "error"
    summary = F.concat(F.lit("Summary of the result number "), k.cast("string"))
    answer = (
        F.when(k % 5 == 0, F.concat(F.lit('Here it is: ```json\n{"n": '), k, F.lit("}\n``` done")))
        .when(k % 5 == 1, F.concat(F.lit('{"n": '), k, F.lit(', "channel": "DIGITAL"}')))
        .when(k % 5 == 2, F.lit("Sorry, this cannot be answered because of privacy"))
        .when(k % 5 == 3, F.lit("The customer totals for BRANCH and DIGITAL are shown in the table above"))
        .otherwise(F.lit("Could not run: an error came back from the engine for this question"))
    )
    return (
        table(spark, folder, "events")
        .withColumn("k", _k())
        .select(
            F.concat(F.lit("s"), n.cast("string")).alias("id"),
            pick(QUESTIONS, k % len(QUESTIONS)).alias("question"),
            pick(SQL_TEXTS, k % len(SQL_TEXTS)).alias("sql_query"),
            F.when(k % 6 == 0, "an error was found").otherwise("fine").alias("sql_explanation"),
            (k % 8 != 0).alias("result_present"),
            F.when(k % 4 == 0, F.lit(True)).when(k % 4 == 1, F.lit(False)).alias("result_success"),
            F.when(k % 10 == 2, "timeout").alias("result_error"),
            (k % 3 != 0).alias("result_has_columns"),
            (k % 6).cast("bigint").alias("row_count"),
            F.when(k % 4 == 0, "pass").when(k % 4 == 1, "warning").when(k % 4 == 2, "fail")
            .alias("quality_status"),
            F.when(k % 3 == 0, "short").when(k % 3 == 1, summary).alias("explanation_summary"),
            (k % 2).alias("insight_count"),
            answer.alias("final_response"),
            F.when(failed, 1 + k % 3).otherwise(0).alias("error_count"),
            F.when(k % 7 != 0, 1 + k % 5).alias("user_score"),
            F.when(k % 4 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("user_feedback"),
            pick(FEEDBACK_WORDS, k % len(FEEDBACK_WORDS)).alias("feedback_word"),
            F.when(k % 9 != 0, (k * 7) % 101).cast("double").alias("self_score"),
            F.col("value").alias("latency_ms"),
            (k * 10).alias("total_tokens"),
            F.when(k % 11 != 0, pick(TAGS, k % len(TAGS))).alias("tags"),
            F.col("ts").alias("created_at"),
            k,
        )
    )


QUERY_LOG = f"""
  SELECT 's' || event_id AS id, {sql_pick(QUESTIONS, f'k % {len(QUESTIONS)}')} AS question,
    {sql_pick(SQL_TEXTS, f'k % {len(SQL_TEXTS)}')} AS sql_query,
    CASE WHEN k % 6 = 0 THEN 'an error was found' ELSE 'fine' END AS sql_explanation,
    k % 8 <> 0 AS result_present,
    CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS result_success,
    CASE WHEN k % 10 = 2 THEN 'timeout' END AS result_error,
    k % 3 <> 0 AS result_has_columns, CAST(k % 6 AS BIGINT) AS row_count,
    CASE k % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' WHEN 2 THEN 'fail' END AS quality_status,
    CASE k % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'Summary of the result number ' || k END
      AS explanation_summary,
    k % 2 AS insight_count,
    CASE k % 5 WHEN 0 THEN 'Here it is: ```json' || chr(10) || '{{"n": ' || k || '}}' || chr(10) || '``` done'
      WHEN 1 THEN '{{"n": ' || k || ', "channel": "DIGITAL"}}'
      WHEN 2 THEN 'Sorry, this cannot be answered because of privacy'
      WHEN 3 THEN 'The customer totals for BRANCH and DIGITAL are shown in the table above'
      ELSE 'Could not run: an error came back from the engine for this question' END AS final_response,
    CASE WHEN event_type = 'error' THEN 1 + k % 3 ELSE 0 END AS error_count,
    CASE WHEN k % 7 <> 0 THEN 1 + k % 5 END AS user_score,
    CASE WHEN k % 4 = 0 THEN 'note ' || k END AS user_feedback,
    {sql_pick(FEEDBACK_WORDS, f'k % {len(FEEDBACK_WORDS)}')} AS feedback_word,
    CAST(CASE WHEN k % 9 <> 0 THEN (k * 7) % 101 END AS DOUBLE) AS self_score,
    value AS latency_ms, k * 10 AS total_tokens,
    CASE WHEN k % 11 <> 0 THEN {sql_pick(TAGS, f'k % {len(TAGS)}')} END AS tags,
    ts AS created_at, k
  FROM (SELECT event_id, ts, value, event_type, {_K} AS k FROM events)"""


# --- traces and spans -------------------------------------------------------------------------------


def traces(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("text")
    action = F.when(size % 7 == 0, "failed").when(size % 5 == 0, "started").otherwise("completed")
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("turn").alias("position"),
        pick(fixed.STAGES, F.col("turn") % 4).alias("agent_name"),
        action.alias("action"),
        size.cast("bigint").alias("duration_ms"),
        F.expr("length(text) div 4").alias("tokens_used"),
        F.when(size % 7 == 0, F.concat(F.lit("code "), (size % 3).cast("string"))).alias("error"),
    )


TRACES = f"""
  SELECT 's' || conv_id AS session_id, turn AS position, {sql_pick(fixed.STAGES, 'turn % 4')} AS agent_name,
    CASE WHEN length(text) % 7 = 0 THEN 'failed' WHEN length(text) % 5 = 0 THEN 'started'
      ELSE 'completed' END AS action,
    CAST(length(text) AS BIGINT) AS duration_ms, CAST(length(text) // 4 AS BIGINT) AS tokens_used,
    CASE WHEN length(text) % 7 = 0 THEN 'code ' || (length(text) % 3) END AS error
  FROM conversations"""


def spans(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("text").cast("bigint")
    start = F.col("turn") * 1000
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("trace_id"),
        F.col("turn").alias("span_id"),
        F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")).alias("parent_id"),
        F.col("role").alias("name"),
        start.alias("start_ms"),
        F.when(size % 5 != 0, start + size).alias("end_ms"),
        F.when(size % 7 == 0, "failed").alias("error"),
    )


SPANS = """
  SELECT conv_id AS trace_id, turn AS span_id,
    CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent_id, role AS name, turn * 1000 AS start_ms,
    CASE WHEN length(text) % 5 <> 0 THEN turn * 1000 + length(text) END AS end_ms,
    CASE WHEN length(text) % 7 = 0 THEN 'failed' END AS error
  FROM conversations"""


# --- vectors ----------------------------------------------------------------------------------------


def docs(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        "embedding",
        F.concat(F.lit("document "), F.col("vec_id").cast("string")).alias("content"),
        F.concat(F.lit("type"), (label % 5).cast("string")).alias("type"),
        F.when(label % 2 == 0, "knowledge").otherwise("schema").alias("collection"),
        label,
    )


DOCS = """
  SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding, 'document ' || vec_id AS content,
    'type' || (label % 5) AS type,
    CASE WHEN label % 2 = 0 THEN 'knowledge' ELSE 'schema' END AS collection, label
  FROM embeddings"""


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean of its vectors."""
    means = vectors.mean_vector("embedding", "label")(table(spark, folder, "embeddings"))
    return means.withColumnRenamed("label", "query_id")


CENTROIDS = """
  SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS embedding
  FROM (
    SELECT label, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS x
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
    GROUP BY label, pos)
  GROUP BY label"""


_VIEWS = {
    "bank_orders": BANK_ORDERS,
    "bank_events": BANK_EVENTS,
    "query_log": QUERY_LOG,
    "traces": TRACES,
    "spans": SPANS,
    "docs": DOCS,
    "centroids": CENTROIDS,
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """A query preceded by the definitions of the views it uses."""
    head = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in names)
    start = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    if body.startswith(","):
        return f"{start}{head}{body}"
    if body[:4].upper() == "WITH":
        return f"{start}{head}, {body[4:]}"
    return f"{start}{head}\n{body}"
