"""Profiling, value discovery, conformance and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.operators import patterns, profiling, quality
from quorumlens.policy import GovernancePolicy
from quorumlens.sources import catalog
from suite import bindings as b
from suite.registry import register

MONTH = "strftime(event_date, '%Y-%m')"

_ORDER_COLUMNS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


@register(
    "table_info",
    f"""SELECT COUNT(*) AS row_count, CAST(MIN(o_orderdate) AS DATE) AS min_date,
         CAST(MAX(o_orderdate) AS DATE) AS max_date, '{_ORDER_COLUMNS}' AS columns FROM orders""",
)
def table_info(spark, folder):
    info = profiling.table_info(b.table(spark, folder, "orders"), "o_orderdate")
    return info.withColumns({c: F.col(c).cast("date") for c in ("min_date", "max_date")})


@register(
    "date_range",
    """SELECT MIN(event_date) AS min_date, MAX(event_date) AS max_date,
         COUNT(DISTINCT event_date) AS num_days FROM bank_orders""",
    "bank_orders",
)
def date_range(spark, folder):
    return profiling.date_range(b.bank_orders(spark, folder), "event_date")


def _discovered_sql(columns: list[str], days: int = 90) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM recent" for c in columns
    )
    return f"""recent AS (SELECT * FROM bank_events WHERE event_date >=
        (SELECT MAX(event_date) FROM bank_events) - INTERVAL {days} DAY),
      discovered AS (SELECT col, v, n, rank FROM (
        SELECT col, v, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY col ORDER BY COUNT(*) DESC, v) AS rank
        FROM ({parts}) WHERE v IS NOT NULL GROUP BY col, v) WHERE rank <= 50)"""


@register(
    "value_discovery",
    f"""WITH {_discovered_sql(fixed.DISCOVERABLE_COLUMNS, 20)}
       SELECT col AS "column", v AS "value", n AS cnt, rank FROM discovered""",
    "bank_events",
)
def value_discovery(spark, folder):
    columns = [*fixed.DISCOVERABLE_COLUMNS, "account_id"]
    policy = GovernancePolicy(window_days=20)
    return profiling.discover(b.bank_events(spark, folder), columns, "event_date", policy)


_DEFINITION = {
    "dimensions": ["month", "product_type"],
    "filters": ["channel = 'BRANCH'", "event_amount > 0"],
}


@register(
    "discovery_for_definition",
    f"""WITH {_discovered_sql(["event_type", "channel", "product_type"])}
       SELECT col AS "column", 'Found ' || COUNT(*) || ' distinct values for ''' || col || ''': ['
         || string_agg('''' || v || '''', ', ' ORDER BY rank) FILTER (rank <= 5) || ']'
         || CASE WHEN COUNT(*) > 5 THEN '...' ELSE '' END AS note
       FROM discovered GROUP BY col
       UNION ALL SELECT 'event_date', MIN(event_date) || ' to ' || MAX(event_date) || ' ('
         || COUNT(DISTINCT event_date) || ' days)' FROM bank_events""",
    "bank_events",
)
def discovery_for_definition(spark, folder):
    rows = b.bank_events(spark, folder)
    columns = profiling.columns_to_discover(_DEFINITION)
    notes = profiling.discovery_notes(profiling.discover(rows, columns, "event_date"))
    span = profiling.date_range(rows, "event_date").select(
        F.lit("event_date").alias("column"),
        F.concat(
            F.col("min_date").cast("string"),
            F.lit(" to "),
            F.col("max_date").cast("string"),
            F.format_string(" (%d days)", "num_days"),
        ).alias("note"),
    )
    return notes.unionByName(span)


@register(
    "discovery_context",
    f"""WITH {_discovered_sql(fixed.DISCOVERABLE_COLUMNS)}
       SELECT col AS "column", string_agg('''' || v || '''', ', ' ORDER BY rank) FILTER (rank <= 10)
         || CASE WHEN COUNT(*) > 10 THEN ' ... (' || COUNT(*) || ' total)' ELSE '' END AS "values"
       FROM discovered GROUP BY col""",
    "bank_events",
)
def discovery_context(spark, folder):
    rows = b.bank_events(spark, folder)
    found = profiling.discover(rows, fixed.DISCOVERABLE_COLUMNS, "event_date")
    return profiling.discovery_context(found)


_ENUMS = {
    "product_type": b.PRODUCTS,
    "event_type": [
        "money_movement", "interest", "fee", "account_status", "gic_lifecycle", "service_action",
    ],
    "channel": b.CHANNELS,
}
_ENUM_ROWS = ", ".join(f"('{c}', '{v}')" for c, values in _ENUMS.items() for v in values)
_FOUND_ROWS = " UNION ALL ".join(f"SELECT '{c}', {c} FROM bank_events" for c in _ENUMS)


@register(
    "enum_conformance",
    f"""WITH expected(c, v) AS (VALUES {_ENUM_ROWS}),
         found AS (SELECT c, v, COUNT(*) AS n FROM ({_FOUND_ROWS}) AS f(c, v) GROUP BY c, v)
       SELECT c AS "column", v AS "value", 'unexpected' AS issue, n AS cnt FROM found
         WHERE (c, v) NOT IN (SELECT (c, v) FROM expected)
       UNION ALL SELECT c, v, 'missing', 0 FROM expected
         WHERE (c, v) NOT IN (SELECT (c, v) FROM found)""",
    "bank_events",
)
def enum_conformance(spark, folder):
    return profiling.enum_conformance(b.bank_events(spark, folder), _ENUMS)


@register(
    "rule_violations",
    """SELECT unnest(['date_matches_timestamp', 'outflow_is_negative', 'inflow_is_positive',
           'monetary_has_amount', 'non_monetary_has_no_amount', 'unique_event_id']) AS rule,
         unnest([a, b, c, d, e, f]) AS violations
       FROM (SELECT COUNT(*) FILTER (event_date <> CAST(event_ts AS DATE)) AS a,
         COUNT(*) FILTER (event_name IN ('withdrawal', 'payment', 'transfer_out') AND event_amount > 0) AS b,
         COUNT(*) FILTER (event_name IN ('deposit', 'transfer_in') AND event_amount < 0) AS c,
         COUNT(*) FILTER (event_type IN ('money_movement', 'interest', 'fee') AND event_amount IS NULL) AS d,
         COUNT(*) FILTER (event_type = 'account_status' AND event_amount IS NOT NULL) AS e,
         COUNT(event_id) - COUNT(DISTINCT event_id) AS f FROM bank_events)""",
    "bank_events",
)
def rule_violations(spark, folder):
    rows = b.bank_events(spark, folder)
    return profiling.rule_violations(rows, profiling.event_rules(), unique="event_id")


@register(
    "balance_continuity",
    """SELECT product_type, COUNT(*) AS n_rows,
         COUNT(*) FILTER (prev IS NOT NULL) AS n_checked,
         COUNT(*) FILTER (prev IS NOT NULL AND balance_after <> prev + step) AS n_breaks
       FROM (SELECT product_type, balance_after, CAST(event_id % 5 - 2 AS DECIMAL(18,2)) AS step,
               LAG(balance_after) OVER (PARTITION BY account_id ORDER BY event_ts, event_id) AS prev
             FROM bank_events)
       GROUP BY product_type""",
    "bank_events",
)
def balance_continuity(spark, folder):
    step = (F.col("event_id") % 5 - 2).cast("decimal(18,2)")
    return profiling.balance_continuity(
        b.bank_events(spark, folder).withColumn("step", step),
        account="account_id",
        order=["event_ts", "event_id"],
        amount="step",
        balance="balance_after",
        bucket=F.date_trunc("day", F.col("event_ts")),
        dims=[F.col("product_type")],
    )


@register(
    "account_fanout",
    """SELECT accounts, COUNT(*) AS customers FROM
         (SELECT customer_id, COUNT(DISTINCT account_id) AS accounts FROM bank_orders GROUP BY 1)
       GROUP BY accounts""",
    "bank_orders",
)
def account_fanout(spark, folder):
    return profiling.account_fanout(b.bank_orders(spark, folder), "customer_id", "account_id")


_EVENT_COLUMNS = [
    ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"),
]


@register(
    "schema_doc",
    "WITH s AS (SELECT * FROM events ORDER BY event_id LIMIT 3) "
    + " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS position, '{name}' AS "column", '{kind}' AS type,
              string_agg(CAST({name} AS VARCHAR), ' | ' ORDER BY event_id) AS samples FROM s"""
        for i, (name, kind) in enumerate(_EVENT_COLUMNS)
    ),
)
def schema_doc(spark, folder):
    return catalog.describe_with_samples(b.table(spark, folder, "events"), "event_id")


# --- data quality of a result -------------------------------------------------------------------------


def _result(spark, folder):
    """A governed result to audit: sums per date and event name, with nulls and negative counts."""
    grouped = b.bank_events(spark, folder).groupBy("event_date", "event_name")
    return grouped.agg(
        F.sum("event_amount").alias("total"),
        F.countDistinct("account_id").alias("unique_accounts"),
        (F.count(F.lit(1)) - 60).alias("count_shift"),
    )


_RESULT = """result AS (SELECT event_date, event_name, SUM(event_amount) AS total,
    COUNT(DISTINCT account_id) AS unique_accounts, COUNT(*) - 60 AS count_shift
  FROM bank_events GROUP BY 1, 2)"""


_HIDDEN = "SELECT channel FROM events GROUP BY channel HAVING COUNT(DISTINCT account_id) >= "


def _has_data(k: int) -> str:
    return f"""SELECT 'has_data' AS "check", CASE WHEN n = 0 THEN 'warning' ELSE 'pass' END AS status,
        CASE WHEN n = 0 THEN 'Query returned no results - likely due to privacy thresholds (fewer than {k} distinct accounts in each bucket)'
          ELSE 'Query returned ' || n || ' rows' END AS message,
        CASE WHEN n = 0 THEN 'k_anonymity_filter' END AS details
      FROM (SELECT COUNT(*) AS n FROM (SELECT channel FROM bank_events GROUP BY channel HAVING COUNT(DISTINCT account_id) >= {k}))"""


@register("dq_has_data", f"{_has_data(1000000)} UNION ALL {_has_data(5)}", "bank_events")
def dq_has_data(spark, folder):
    def check(k):
        policy = GovernancePolicy(k=k)
        result = patterns.safe_summary(b.bank_events(spark, folder), ["channel"], policy)
        return quality.report(result, f"{_HIDDEN}{k}", policy).filter(F.col("check") == "has_data")

    return check(1000000).unionByName(check(5))


@register(
    "dq_null_counts",
    f"""WITH {_RESULT}
       SELECT 'total' AS "column", COUNT(*) FILTER (total IS NULL) AS nulls,
         CAST(COUNT(*) FILTER (total IS NULL) AS DOUBLE) / COUNT(*) AS null_rate FROM result""",
    "bank_events",
)
def dq_null_counts(spark, folder):
    return quality.null_counts(_result(spark, folder))


@register(
    "dq_null_rate",
    """SELECT 'event_amount' AS "column", COUNT(*) - COUNT(event_amount) AS nulls,
         CAST(COUNT(*) - COUNT(event_amount) AS DOUBLE) / COUNT(*) AS null_rate FROM bank_events""",
    "bank_events",
)
def dq_null_rate(spark, folder):
    return quality.null_rate(b.bank_events(spark, folder).drop("k"), 0.10)


@register(
    "row_cap_check",
    """SELECT 'row_count' AS "check", CASE WHEN n > 200 THEN 'warning' ELSE 'pass' END AS status,
         CASE WHEN n > 200 THEN 'Large result set (' || n || ' rows) exceeds recommended limit of 200' WHEN n = 1 THEN 'Single aggregate result'
           ELSE 'Row count (' || n || ') is reasonable' END AS message
       FROM (SELECT COUNT(*) AS n FROM (SELECT event_date, channel FROM bank_orders GROUP BY 1, 2))
       UNION ALL SELECT 'row_count', 'pass', 'Row count (' || COUNT(*) || ') is reasonable'
       FROM (SELECT channel FROM bank_orders GROUP BY 1)""",
    "bank_orders",
)
def row_cap_check(spark, folder):
    rows = b.bank_orders(spark, folder)
    counted = F.count(F.lit(1)).alias("n")
    large = quality.row_cap(rows.groupBy("event_date", "channel").agg(counted))
    return large.unionByName(quality.row_cap(rows.groupBy("channel").agg(counted)))


@register(
    "dq_negative_counts",
    f"""WITH {_RESULT}
       SELECT 'count_shift' AS "column", COUNT(*) AS negatives FROM result
       WHERE count_shift < 0 HAVING COUNT(*) > 0""",
    "bank_events",
)
def dq_negative_counts(spark, folder):
    return quality.negative_counts(_result(spark, folder))


@register(
    "dq_outliers",
    f"""WITH monthly AS (SELECT product_type, {MONTH} AS month,
           CAST(SUM(event_amount) AS DOUBLE) AS net_flow FROM bank_orders GROUP BY 1, 2),
         q AS (SELECT product_type, quantile_cont(net_flow, 0.25) AS q1, quantile_cont(net_flow, 0.75) AS q3
           FROM monthly GROUP BY 1)
       SELECT product_type, month, net_flow FROM monthly JOIN q USING (product_type)
       WHERE net_flow < q1 - 0.75 * (q3 - q1) OR net_flow > q3 + 0.75 * (q3 - q1)""",
    "bank_orders",
)
def dq_outliers(spark, folder):
    monthly = (
        b.bank_orders(spark, folder)
        .groupBy("product_type", F.date_format("event_date", "yyyy-MM").alias("month"))
        .agg(F.sum("event_amount").alias("net_flow"))
    )
    found = quality.outliers(monthly, "net_flow", ["product_type"], "iqr", factor=0.75)
    return found.select("product_type", "month", "net_flow")


@register(
    "dq_outliers_raw",
    """WITH q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
           FROM (SELECT event_type, CAST(event_amount AS DOUBLE) AS v FROM bank_events WHERE event_amount IS NOT NULL) GROUP BY 1)
       SELECT event_type, event_id, CAST(event_amount AS DOUBLE) AS event_amount, round(q1 - 1.5 * (q3 - q1), 6) AS low,
         round(q3 + 1.5 * (q3 - q1), 6) AS high
       FROM bank_events JOIN q USING (event_type)
       WHERE event_amount < q1 - 1.5 * (q3 - q1) OR event_amount > q3 + 1.5 * (q3 - q1)""",
    "bank_events",
)
def dq_outliers_raw(spark, folder):
    """Exact quartiles of a raw table, of which one event type holds most rows."""
    found = quality.outliers(b.bank_events(spark, folder), "event_amount", ["event_type"])
    bounds = [F.round(c, 6).alias(c) for c in ("low", "high")]
    return found.select("event_type", "event_id", "event_amount", *bounds)


@register(
    "dq_reconcile",
    """SELECT CAST(SUM(p) AS DOUBLE) AS sum_of_parts,
         (SELECT CAST(SUM(event_amount) AS DOUBLE) FROM bank_orders) AS total,
         SUM(p) = (SELECT SUM(event_amount) FROM bank_orders) AS reconciles
       FROM (SELECT SUM(event_amount) AS p FROM bank_orders GROUP BY channel, product_type)""",
    "bank_orders",
)
def dq_reconcile(spark, folder):
    rows = b.bank_orders(spark, folder)
    return quality.reconcile(rows, ["channel", "product_type"], "event_amount")


@register(
    "dq_percentages",
    """SELECT 'pct' AS "column", COUNT(*) FILTER (pct NOT BETWEEN 0 AND 100) AS out_of_range FROM
         (SELECT event_name, 100 * CAST(SUM(event_amount) AS DOUBLE)
            / (SELECT CAST(SUM(event_amount) AS DOUBLE) FROM bank_events) AS pct
          FROM bank_events WHERE event_amount IS NOT NULL GROUP BY event_name)""",
    "bank_events",
)
def dq_percentages(spark, folder):
    rows = b.bank_events(spark, folder).filter(F.col("event_amount").isNotNull())
    sums = rows.groupBy("event_name").agg(F.sum("event_amount").cast("double").alias("s"))
    whole = rows.agg(F.sum("event_amount").cast("double")).scalar()
    return quality.percentages_in_range(sums.withColumn("pct", 100 * F.col("s") / whole), ["pct"])


@register(
    "dq_report",
    f"""WITH {_RESULT},
         f AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (total IS NULL) AS nulls,
           COUNT(*) FILTER (count_shift < 0) AS neg,
           COUNT(*) FILTER (unique_accounts < 5) + COUNT(*) FILTER (count_shift < 5) AS small FROM result),
         checks AS (
           SELECT 'has_data' AS "check", 'pass' AS status, 'Query returned ' || n || ' rows' AS message,
             NULL AS details FROM f
           UNION ALL SELECT 'null_check', CASE WHEN nulls > 0 THEN 'warning' ELSE 'pass' END,
             CASE WHEN nulls > 0 THEN 'Found null values in 1 column(s)' ELSE 'No null values found' END,
             CASE WHEN nulls > 0 THEN 'total=' || nulls END FROM f
           UNION ALL SELECT 'row_count', CASE WHEN n > 200 THEN 'warning' ELSE 'pass' END,
             CASE WHEN n > 200 THEN 'Large result set (' || n || ' rows) exceeds recommended limit of 200'
               ELSE 'Row count (' || n || ') is reasonable' END, CAST(n AS VARCHAR) FROM f
           UNION ALL SELECT 'numeric_check', CASE WHEN neg > 0 THEN 'warning' ELSE 'pass' END,
             CASE WHEN neg > 0 THEN 'Column ''count_shift'' has ' || neg || ' negative value(s)'
               ELSE 'Numeric values look reasonable' END, NULL FROM f
           UNION ALL SELECT 'privacy_k_anonymity', CASE WHEN small > 0 THEN 'warning' ELSE 'pass' END,
             CASE WHEN small > 0 THEN 'Found ' || small || ' bucket(s) with count < 5'
               ELSE 'All buckets meet k-anonymity threshold (>= 5)' END, CAST(small AS VARCHAR) FROM f
           UNION ALL SELECT 'forbidden_columns', 'pass', 'No forbidden columns in output', NULL)
       SELECT * FROM checks
       UNION ALL SELECT 'overall', MAX(status), CASE WHEN COUNT(*) FILTER (status = 'warning') > 0
         THEN 'Data quality checks passed with warnings' ELSE 'All data quality checks passed' END,
         string_agg("check", ', ' ORDER BY "check") FILTER (status = 'warning') FROM checks""",
    "bank_events",
)
def dq_report(spark, folder):
    return quality.report(_result(spark, folder))
