"""Definition-driven aggregates, named metrics and query patterns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quorumlens.functions import terms
from quorumlens.operators import patterns, privacy
from quorumlens.plans import definition
from quorumlens.policy import GovernancePolicy
from suite import bindings as b
from suite.registry import register

#: A threshold that hides some but not all groups of the small test tables.
K = 30

MOVEMENT = "event_type = 'money_movement'"
MONTH = "strftime(event_date, '%Y-%m')"

NET_FLOW_SQL = f"""SELECT {MONTH} AS month, product_type, CAST(SUM(event_amount) AS DOUBLE) AS net_flow
  FROM bank_orders WHERE {MOVEMENT} GROUP BY 1, 2
  HAVING COUNT(DISTINCT account_id) >= 5"""


@register("definition_agg", NET_FLOW_SQL, "bank_orders")
def definition_agg(spark, folder):
    spec = {
        "metric": {"function": "SUM", "column": "event_amount", "alias": "net_flow"},
        "dimensions": ["month", "product_type"],
        "filters": [{"column": "event_type", "operator": "=", "value": "money_movement"}],
        "time_range": {"start": None, "end": None, "period": "monthly"},
    }
    return definition.run(b.bank_orders(spark, folder), definition.normalise(spec))


@register(
    "definition_text_filters",
    f"""SELECT channel, COUNT(*) AS n, CAST(SUM(event_amount) AS DOUBLE) AS total FROM bank_orders
       WHERE channel IN ('DIGITAL', 'BRANCH') AND event_type LIKE 'money%' AND event_amount BETWEEN 10 AND 100000
         AND product_type IS NOT NULL AND event_amount > 20 AND currency <> 'it''s'
       GROUP BY channel HAVING COUNT(DISTINCT account_id) >= 5
       UNION ALL SELECT 'total', COUNT(*), CAST(SUM(event_amount) AS DOUBLE) FROM bank_orders
       WHERE channel IN ('DIGITAL', 'BRANCH') AND event_amount > 20 HAVING COUNT(DISTINCT account_id) >= 5""",
    "bank_orders",
)
def definition_text_filters(spark, folder):
    rows = b.bank_orders(spark, folder)
    spec = {
        "metrics": ["COUNT(*)", "SUM(event_amount)"],
        "dimensions": ["channel"],
        "filters": {
            "channel": "IN ('DIGITAL', 'BRANCH')",
            "event_type": "LIKE 'money%'",
            "event_amount": "BETWEEN 10 AND 100000",
            "product_type": "IS NOT NULL",
        },
    }
    more = ["event_amount > 20", "currency != 'it''s'", "channel"]
    first = definition.normalise(spec)
    second = definition.normalise(spec | {"filters": more})
    both = replace(first, filters=first.filters + second.filters)
    whole = definition.normalise(
        spec | {"dimensions": [], "filters": [{"column": "channel", "operator": "IN", "value": "'DIGITAL', 'BRANCH'"}, more[0]]}
    )
    names = {"count_rows": "n", "sum_event_amount": "total"}
    total = definition.run(rows, whole).select(F.lit("total").alias("channel"), *names)
    return definition.run(rows, both).select("channel", *names).unionByName(total).withColumnsRenamed(names)


@register(
    "definition_period",
    f"""SELECT {MONTH} AS month, COUNT(*) AS n FROM bank_orders GROUP BY 1 HAVING COUNT(DISTINCT account_id) >= 5""",
    "bank_orders",
)
def definition_period(spark, folder):
    spec = {
        "metric": {"function": "COUNT", "column": None, "alias": "n"},
        "time_range": {"start": "null", "end": None, "period": "monthly"},
    }
    return definition.run(b.bank_orders(spark, folder), definition.normalise(spec))


@register(
    "definition_named_metrics",
    f"""SELECT product_type, CAST(SUM(event_amount) FILTER ({MOVEMENT}) AS DOUBLE) AS net_flow,
         COUNT(*) FILTER ({MOVEMENT}) AS transaction_count,
         CAST(ABS(SUM(event_amount) FILTER (event_type = 'fee')) AS DOUBLE) AS total_fees
       FROM bank_events GROUP BY 1 HAVING COUNT(DISTINCT account_id) >= 5""",
    "bank_events",
)
def definition_named_metrics(spark, folder):
    spec = {"metrics": ["Net Flow", "Transaction Count", "Total Fees Collected"], "dimensions": ["product_type"]}
    return definition.run(b.bank_events(spark, folder), definition.normalise(spec))


_METRIC_SQL = {
    "m_total_deposits": (
        "total_deposits",
        f"CAST(SUM(event_amount) FILTER (event_amount > 0 AND {MOVEMENT}) AS DOUBLE)",
    ),
    "m_total_withdrawals": (
        "total_withdrawals",
        f"CAST(ABS(SUM(event_amount) FILTER (event_amount < 0 AND {MOVEMENT})) AS DOUBLE)",
    ),
    "m_net_flow": ("net_flow", f"CAST(SUM(event_amount) FILTER ({MOVEMENT}) AS DOUBLE)"),
    "m_txn_count": ("transaction_count", f"COUNT(*) FILTER ({MOVEMENT})"),
    "m_active_customers": ("active_customers", "COUNT(DISTINCT customer_id)"),
    "m_txn_per_customer": (
        "avg_transactions_per_customer",
        f"CAST(COUNT(*) FILTER ({MOVEMENT}) AS DOUBLE) / NULLIF(COUNT(DISTINCT customer_id), 0)",
    ),
    "m_digital_adoption": (
        "digital_adoption_rate",
        "CAST(100.0 AS DOUBLE) * COUNT(*) FILTER (channel = 'DIGITAL') / COUNT(*)",
    ),
    "m_total_fees": (
        "total_fees",
        "CAST(ABS(SUM(event_amount) FILTER (event_type = 'fee')) AS DOUBLE)",
    ),
    "m_fee_events": ("fee_events", "COUNT(*) FILTER (event_type = 'fee')"),
    "m_alt_deposits": (
        "alt_deposits",
        "CAST(SUM(CASE WHEN event_amount > 0 THEN event_amount ELSE 0 END) AS DOUBLE)",
    ),
    "m_alt_withdrawals": (
        "alt_withdrawals",
        "CAST(SUM(CASE WHEN event_amount < 0 THEN ABS(event_amount) ELSE 0 END) AS DOUBLE)",
    ),
}


def _metric_query(name):
    def run(spark, folder):
        rows = b.bank_events(spark, folder)
        return rows.groupBy("event_date", "product_type").agg(terms.metric(name))

    return run


for _key, (_name, _sql) in _METRIC_SQL.items():
    register(
        _key,
        f"SELECT event_date, product_type, {_sql} AS {_name} FROM bank_events GROUP BY 1, 2",
        "bank_events",
    )(_metric_query(_name))


@register(
    "m_alt_counts",
    """SELECT product_type, COUNT(*) AS event_count, COUNT(DISTINCT customer_id) AS unique_customers
       FROM bank_events GROUP BY product_type""",
    "bank_events",
)
def m_alt_counts(spark, folder):
    rows = b.bank_events(spark, folder)
    return rows.groupBy("product_type").agg(
        terms.metric("event_count"), terms.metric("unique_customers")
    )


@register(
    "daily_summary",
    f"""SELECT event_date, COUNT(*) AS event_count,
         CAST(SUM(CASE WHEN event_amount > 0 THEN event_amount ELSE 0 END) AS DOUBLE) AS deposits,
         CAST(ABS(SUM(CASE WHEN event_amount < 0 THEN event_amount ELSE 0 END)) AS DOUBLE) AS withdrawals
       FROM bank_orders WHERE {MOVEMENT} GROUP BY event_date ORDER BY event_date""",
    "bank_orders",
)
def daily_summary(spark, folder):
    return patterns.daily_summary(b.bank_orders(spark, folder))


@register(
    "product_mix",
    """SELECT product_type, COUNT(DISTINCT account_id) AS accounts, COUNT(*) AS events,
         CAST(SUM(event_amount) AS DOUBLE) AS net_flow
       FROM bank_orders GROUP BY product_type""",
    "bank_orders",
)
def product_mix(spark, folder):
    return patterns.product_mix(b.bank_orders(spark, folder))


@register(
    "channel_share",
    f"""SELECT channel, transactions,
         CAST((transactions * 20000 + total) // (2 * total) AS DOUBLE) / 100 AS pct
       FROM (SELECT channel, COUNT(*) AS transactions, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total
             FROM bank_orders WHERE {MOVEMENT} GROUP BY channel)
       ORDER BY transactions DESC, channel""",
    "bank_orders",
)
def channel_share(spark, folder):
    return patterns.channel_share(b.bank_orders(spark, folder))


@register(
    "top_entities_internal",
    f"""SELECT customer_id, COUNT(*) AS event_count, CAST(SUM(event_amount) AS DOUBLE) AS net_flow
       FROM bank_orders WHERE {MOVEMENT} GROUP BY customer_id
       ORDER BY event_count DESC, customer_id LIMIT 10""",
    "bank_orders",
)
def top_entities_internal(spark, folder):
    return patterns.top_entities(b.bank_orders(spark, folder))


@register(
    "question_mapping",
    f"""SELECT 'How much money was deposited?' AS question, '' AS label,
         CAST(SUM(event_amount) FILTER (event_amount > 0 AND {MOVEMENT}) AS DOUBLE) AS answer
         FROM bank_events
       UNION ALL SELECT 'What''s the transaction volume?', '', COUNT(*) FILTER ({MOVEMENT}) FROM bank_events
       UNION ALL SELECT 'What fees were charged?', '',
         CAST(SUM(event_amount) FILTER (event_type = 'fee') AS DOUBLE) FROM bank_events
       UNION ALL SELECT 'How many accounts were opened?', '',
         COUNT(*) FILTER (event_name = 'account_opened') FROM bank_events
       UNION ALL SELECT 'Show me the channel breakdown', channel, COUNT(*) FROM bank_events GROUP BY channel
       UNION ALL SELECT 'Which customers are most active?', CAST(bucket AS VARCHAR), COUNT(*)
         FROM (SELECT COUNT(*) // 20 AS bucket FROM bank_events GROUP BY customer_id) GROUP BY bucket
       UNION ALL SELECT 'Daily trend of deposits', strftime(event_date, '%Y-%m-%d'),
         CAST(SUM(event_amount) AS DOUBLE) FROM bank_events
         WHERE event_amount > 0 AND {MOVEMENT} GROUP BY event_date""",
    "bank_events",
)
def question_mapping(spark, folder):
    rows = b.bank_events(spark, folder)
    one = F.count(F.lit(1))

    def labelled(df, question, label, answer):
        return df.select(
            F.lit(question).alias("question"),
            label.cast("string").alias("label"),
            F.col(answer).cast("double").alias("answer"),
        )

    answers = patterns.answer_mapped_questions(rows)
    channels = rows.groupBy("channel").agg(one.alias("n"))
    # the customer ranking is answered by a distribution, so no identifier is shown
    active = rows.groupBy("customer_id").agg(one.alias("events"))
    active = active.groupBy(F.expr("events div 20").alias("bucket")).agg(one.alias("n"))
    daily = patterns.daily_deposit_trend(rows)
    return (
        answers.select("question", F.lit("").alias("label"), F.col("answer").cast("double"))
        .unionByName(labelled(channels, "Show me the channel breakdown", F.col("channel"), "n"))
        .unionByName(labelled(active, "Which customers are most active?", F.col("bucket"), "n"))
        .unionByName(
            labelled(daily, "Daily trend of deposits", F.col("event_date"), "deposits")
        )
    )


@register(
    "monthly_net_flow",
    f"""SELECT {MONTH} AS month, product_type, CAST(SUM(event_amount) AS DOUBLE) AS net_flow
       FROM bank_orders WHERE {MOVEMENT} GROUP BY 1, 2
       HAVING COUNT(DISTINCT account_id) >= 5 ORDER BY 1, 2""",
    "bank_orders",
)
def monthly_net_flow(spark, folder):
    return patterns.monthly_net_flow(b.bank_orders(spark, folder))


@register(
    "monthly_volume",
    f"SELECT {MONTH} AS month, COUNT(*) AS transactions FROM bank_orders WHERE {MOVEMENT} GROUP BY 1",
    "bank_orders",
)
def monthly_volume(spark, folder):
    return patterns.monthly_volume(b.bank_orders(spark, folder))


@register(
    "inflow_outflow",
    f"""SELECT {MONTH} AS month, product_type,
         CAST(SUM(CASE WHEN event_amount > 0 THEN event_amount ELSE 0 END) AS DOUBLE) AS inflow,
         CAST(SUM(CASE WHEN event_amount < 0 THEN -event_amount ELSE 0 END) AS DOUBLE) AS outflow
       FROM bank_orders WHERE {MOVEMENT} GROUP BY 1, 2
       HAVING COUNT(DISTINCT account_id) >= 5""",
    "bank_orders",
)
def inflow_outflow(spark, folder):
    return patterns.inflow_outflow(b.bank_orders(spark, folder))


@register(
    "default_trend",
    f"""SELECT {MONTH} AS month, COUNT(*) AS transactions,
         CAST(SUM(CASE WHEN event_amount > 0 THEN event_amount ELSE 0 END) AS DOUBLE) AS inflow,
         CAST(SUM(CASE WHEN event_amount < 0 THEN -event_amount ELSE 0 END) AS DOUBLE) AS outflow,
         CAST(SUM(event_amount) AS DOUBLE) AS net_flow
       FROM bank_orders WHERE {MOVEMENT} GROUP BY 1""",
    "bank_orders",
)
def default_trend(spark, folder):
    return patterns.default_trend(b.bank_orders(spark, folder))


@register(
    "recent_activity",
    f"""WITH newest AS (SELECT MAX(event_date) AS d FROM bank_orders),
         complete AS (SELECT CASE WHEN d = last_day(d) THEN CAST(date_trunc('month', d) AS DATE)
           ELSE CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) END AS s FROM newest)
       SELECT 'recent' AS span, channel, COUNT(*) AS n FROM bank_orders, newest
         WHERE event_date > CAST(d - INTERVAL 3 MONTH AS DATE) GROUP BY channel
       UNION ALL SELECT 'last month', channel, COUNT(*) FROM bank_orders, complete
         WHERE event_date BETWEEN s AND last_day(s) GROUP BY channel
       UNION ALL SELECT 'this year', channel, COUNT(*) FROM bank_orders, newest
         WHERE year(event_date) = year(d) GROUP BY channel""",
    "bank_orders",
)
def recent_activity(spark, folder):
    rows = b.bank_orders(spark, folder)
    spans = {
        "recent": patterns.recent(rows),
        "last month": patterns.last_complete_month(rows),
        "this year": patterns.latest_year(rows),
    }
    parts = [
        df.groupBy(F.lit(name).alias("span"), "channel").agg(F.count(F.lit(1)).alias("n"))
        for name, df in spans.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "avg_balance_by_product",
    """SELECT product_type, CAST(SUM(balance) AS DOUBLE) / COUNT(balance) AS avg_balance
       FROM (SELECT c_mktsegment AS product_type, c_custkey AS account_id,
               CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer)
       GROUP BY product_type HAVING COUNT(DISTINCT account_id) >= 5""",
)
def avg_balance_by_product(spark, folder):
    accounts = b.table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("product_type"),
        F.col("c_custkey").alias("account_id"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance"),
    )
    return patterns.average_balance(accounts, "product_type", "balance", "account_id")


@register(
    "safe_summary",
    """SELECT product_type, event_type, COUNT(*) AS events,
         CAST(SUM(event_amount) AS DOUBLE) AS total_amount, COUNT(DISTINCT account_id) AS entities
       FROM bank_events GROUP BY 1, 2 HAVING COUNT(DISTINCT account_id) >= 5
""",
    "bank_events",
)
def safe_summary(spark, folder):
    return patterns.safe_summary(b.bank_events(spark, folder), ["product_type", "event_type"])


@register(
    "channel_compare",
    f"""SELECT *, CASE GREATEST("DIGITAL", "BRANCH", "CALL_CENTER", "BATCH") WHEN "DIGITAL" THEN 'DIGITAL'
          WHEN "BRANCH" THEN 'BRANCH' WHEN "CALL_CENTER" THEN 'CALL_CENTER' ELSE 'BATCH' END AS busiest
       FROM (SELECT {MONTH} AS month,
         COUNT(*) FILTER (channel = 'DIGITAL') AS "DIGITAL", COUNT(*) FILTER (channel = 'BRANCH') AS "BRANCH",
         COUNT(*) FILTER (channel = 'CALL_CENTER') AS "CALL_CENTER",
         COUNT(*) FILTER (channel = 'BATCH') AS "BATCH"
         FROM bank_orders WHERE {MOVEMENT} GROUP BY 1)""",
    "bank_orders",
)
def channel_compare(spark, folder):
    return patterns.channel_compare(b.bank_orders(spark, folder), b.CHANNELS)


_MONTHLY = f"""monthly AS (
    SELECT product_type, {MONTH} AS month, SUM(event_amount) AS flow
    FROM bank_orders WHERE {MOVEMENT} GROUP BY 1, 2),
  changes AS (SELECT *, LAG(flow) OVER (PARTITION BY product_type ORDER BY month) AS prev FROM monthly)"""


@register(
    "month_over_month",
    f"""WITH {_MONTHLY}
       SELECT product_type, month, CAST(flow AS DOUBLE) AS net_flow, CAST(prev AS DOUBLE) AS previous,
         CAST(flow - prev AS DOUBLE) AS change,
         CAST(100 * (flow - prev) AS DOUBLE) / NULLIF(CAST(ABS(prev) AS DOUBLE), 0) AS change_pct
       FROM changes""",
    "bank_orders",
)
def month_over_month(spark, folder):
    return patterns.month_over_month(b.bank_orders(spark, folder), ["product_type"])


@register(
    "trend_drivers",
    f"""WITH {_MONTHLY}
       SELECT product_type, month, CAST(flow - prev AS DOUBLE) AS change,
         CAST(SUM(flow - prev) OVER (PARTITION BY month) AS DOUBLE) AS month_change,
         CAST(100 * (flow - prev) AS DOUBLE)
           / NULLIF(CAST(SUM(flow - prev) OVER (PARTITION BY month) AS DOUBLE), 0) AS share_pct
       FROM changes WHERE prev IS NOT NULL""",
    "bank_orders",
)
def trend_drivers(spark, folder):
    return patterns.trend_drivers(b.bank_orders(spark, folder), "product_type")


@register(
    "result_preview",
    f"SELECT {MONTH} AS month, COUNT(*) AS n FROM bank_orders GROUP BY 1 ORDER BY month LIMIT 10",
    "bank_orders",
)
def result_preview(spark, folder):
    monthly = b.bank_orders(spark, folder).groupBy(F.date_format("event_date", "yyyy-MM").alias("month"))
    return patterns.preview(monthly.agg(F.count(F.lit(1)).alias("n")))


# --- privacy ----------------------------------------------------------------------------------------


@register(
    "k_anon_having",
    f"""SELECT {MONTH} AS month, product_type, COUNT(*) AS n, COUNT(DISTINCT account_id) AS entities
       FROM bank_orders GROUP BY 1, 2 HAVING COUNT(DISTINCT account_id) >= {K}""",
    "bank_orders",
)
def k_anon_having(spark, folder):
    rows = b.bank_orders(spark, folder)
    dims = [F.date_format("event_date", "yyyy-MM").alias("month"), F.col("product_type")]
    counts = [F.count(F.lit(1)).alias("n")]
    return privacy.k_anon(rows, dims, counts, "account_id", K, keep_entities=True)


@register(
    "k_anon_report",
    f"""SELECT COUNT(*) FILTER (e >= {K}) AS kept_groups, COUNT(*) FILTER (e < {K}) AS suppressed_groups,
         CAST(COALESCE(SUM(n) FILTER (e >= {K}), 0) AS BIGINT) AS kept_rows,
         CAST(COALESCE(SUM(n) FILTER (e < {K}), 0) AS BIGINT) AS suppressed_rows
       FROM (SELECT {MONTH} AS month, product_type, COUNT(*) AS n, COUNT(DISTINCT account_id) AS e
             FROM bank_orders GROUP BY 1, 2)""",
    "bank_orders",
)
def k_anon_report(spark, folder):
    dims = [F.date_format("event_date", "yyyy-MM").alias("month"), F.col("product_type")]
    return privacy.k_anon_report(b.bank_orders(spark, folder), dims, "account_id", K)


@register(
    "k_anon_rollup",
    f"""WITH
      l3 AS (SELECT year(event_date) AS y, {MONTH} AS m, product_type AS p, SUM(event_amount) AS t,
               COUNT(*) AS n, COUNT(DISTINCT account_id) AS e FROM bank_orders GROUP BY 1, 2, 3),
      l2 AS (SELECT year(event_date) AS y, {MONTH} AS m, SUM(event_amount) AS t,
               COUNT(*) AS n, COUNT(DISTINCT account_id) AS e FROM bank_orders GROUP BY 1, 2),
      l1 AS (SELECT year(event_date) AS y, SUM(event_amount) AS t,
               COUNT(*) AS n, COUNT(DISTINCT account_id) AS e FROM bank_orders GROUP BY 1),
      l0 AS (SELECT SUM(event_amount) AS t, COUNT(*) AS n, COUNT(DISTINCT account_id) AS e FROM bank_orders),
      ok0 AS (SELECT MIN(e) >= {K} AS ok FROM l1),
      ok1 AS (SELECT y, MIN(e) >= {K} AS ok FROM l2 GROUP BY y),
      ok2 AS (SELECT y, m, MIN(e) >= {K} AS ok FROM l3 GROUP BY y, m),
      shown AS (
        SELECT 0 AS level, NULL AS y, NULL AS m, NULL AS p, t, n, e FROM l0, ok0 WHERE NOT ok AND e >= {K}
        UNION ALL SELECT 1, y, NULL, NULL, t, n, e FROM l1 JOIN ok1 USING (y), ok0
          WHERE ok0.ok AND NOT ok1.ok
        UNION ALL SELECT 2, y, m, NULL, t, n, e FROM l2 JOIN ok1 USING (y) JOIN ok2 USING (y, m), ok0
          WHERE ok0.ok AND ok1.ok AND NOT ok2.ok
        UNION ALL SELECT 3, y, m, p, t, n, e FROM l3 JOIN ok1 USING (y) JOIN ok2 USING (y, m), ok0
          WHERE ok0.ok AND ok1.ok AND ok2.ok)
      SELECT CAST(level AS BIGINT) AS level, CAST(y AS BIGINT) AS year, CAST(m AS VARCHAR) AS month,
        CAST(p AS VARCHAR) AS product_type, CAST(t AS DOUBLE) AS total, CAST(n AS BIGINT) AS n,
        e AS entities
      FROM shown""",
    "bank_orders",
)
def k_anon_rollup(spark, folder):
    rows = (
        b.bank_orders(spark, folder)
        .withColumn("year", F.year("event_date"))
        .withColumn("month", F.date_format("event_date", "yyyy-MM"))
    )
    measures = {"total": ("sum", "event_amount"), "n": ("count", "event_id")}
    dims = ["year", "month", "product_type"]
    return privacy.k_anon_rollup(rows, dims, measures, "account_id", K)


@register(
    "forbidden_columns",
    """SELECT 'orders' AS table_name, k AS forbidden, (SELECT COUNT(*) FROM bank_orders) AS n_rows
       FROM (SELECT unnest(json_keys(to_json(x))) AS k FROM (SELECT * FROM bank_orders LIMIT 1) x)
       WHERE lower(k) IN ('customer_id', 'account_id')""",
    "bank_orders",
)
def forbidden_columns(spark, folder):
    rows = b.bank_orders(spark, folder)
    found = GovernancePolicy().forbidden_in(rows.columns)
    names = F.explode(F.array(*[F.lit(c) for c in found])).alias("forbidden")
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.lit("orders").alias("table_name"), names, "n_rows")


@register(
    "k_anon_audit",
    f"""SELECT 'unique_accounts' AS "column", CAST(e AS DOUBLE) AS "count",
         '{{"event_date":"' || strftime(event_date, '%Y-%m-%d') || '","channel":"' || channel || '"}}' AS dimensions
       FROM (SELECT event_date, channel, COUNT(DISTINCT account_id) AS e FROM bank_orders GROUP BY 1, 2)
       WHERE e < 5""",
    "bank_orders",
)
def k_anon_audit(spark, folder):
    grouped = b.bank_orders(spark, folder).groupBy("event_date", "channel")
    result = grouped.agg(F.countDistinct("account_id").alias("unique_accounts"))
    return privacy.audit(result, 5)


@register(
    "entity_distribution",
    f"""SELECT CAST(bucket AS BIGINT) AS bucket, COUNT(*) AS entities, CAST(SUM(t) AS DOUBLE) AS total
       FROM (SELECT t, (CASE WHEN t >= 0 THEN 1 ELSE 0 END) + (CASE WHEN t >= 500000 THEN 1 ELSE 0 END)
               + (CASE WHEN t >= 1000000 THEN 1 ELSE 0 END) AS bucket
             FROM (SELECT account_id, SUM(event_amount) AS t FROM bank_orders WHERE {MOVEMENT} GROUP BY 1))
       GROUP BY bucket HAVING COUNT(*) >= 5""",
    "bank_orders",
)
def entity_distribution(spark, folder):
    rows = b.bank_orders(spark, folder).filter(terms.predicate("transactions"))
    edges = [0, 500000, 1000000]
    return privacy.entity_distribution(rows, "account_id", "event_amount", edges, 5)


@register(
    "single_entity_flag",
    """SELECT COUNT(*) AS n_groups, COUNT(*) FILTER (e = 1) AS single_entity_groups
       FROM (SELECT event_date, product_type, channel, COUNT(DISTINCT account_id) AS e
             FROM bank_orders GROUP BY 1, 2, 3)""",
    "bank_orders",
)
def single_entity_flag(spark, folder):
    dims = ["event_date", "product_type", "channel"]
    return privacy.single_entity_groups(b.bank_orders(spark, folder), dims, "account_id")
