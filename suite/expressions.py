"""Filters, projections, scalar functions, plain aggregates, set operations and pass-through SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quorumlens.functions import terms, textguard
from quorumlens.operators import profiling
from quorumlens.plans.definition import Filter, TimeRange
from quorumlens.plans.schema import EVENT_STRUCT, EVENTS, grain
from quorumlens.policy import GovernancePolicy
from quorumlens.session import scratch_path
from quorumlens.sources import events as event_source
from suite import bindings as b
from suite.registry import register

SUM_AS_DOUBLE = "CAST(SUM(event_amount) AS DOUBLE)"


@register(
    "scan_alias",
    """SELECT source, event_type, COUNT(*) AS n FROM (
         SELECT 'events' AS source, event_type FROM bank_events
         UNION ALL SELECT 'sample_events', event_type FROM bank_events)
       GROUP BY source, event_type""",
    "bank_events",
)
def scan_alias(spark, folder):
    event_source.register(b.bank_events(spark, folder))
    return spark.sql(
        """SELECT source, event_type, COUNT(*) AS n FROM (
             SELECT 'events' AS source, event_type FROM events
             UNION ALL SELECT 'sample_events' AS source, event_type FROM sample_events)
           GROUP BY source, event_type"""
    )


@register(
    "scan_project",
    """SELECT channel, product_type AS product, CAST(event_amount AS DOUBLE) AS amount
       FROM bank_orders WHERE event_type = 'money_movement'""",
    "bank_orders",
)
def scan_project(spark, folder):
    movements = b.bank_orders(spark, folder).filter(terms.predicate("transactions"))
    return movements.select(
        "channel", F.col("product_type").alias("product"), F.col("event_amount").alias("amount")
    )


@register(
    "filter_compare",
    f"""SELECT channel, COUNT(*) AS n, {SUM_AS_DOUBLE} AS total FROM bank_orders
        WHERE event_type = 'money_movement' AND event_amount > 100000 AND account_id < 1000000
        GROUP BY channel""",
    "bank_orders",
)
def filter_compare(spark, folder):
    rows = b.bank_orders(spark, folder)
    for f in (
        Filter("event_type", "=", "money_movement"),
        Filter("event_amount", ">", 100000),
        Filter("account_id", "<", 1000000),
    ):
        rows = rows.filter(f.condition())
    return rows.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_amount").alias("total")
    )


@register(
    "filter_in_like",
    """SELECT event_name, channel, COUNT(*) AS n FROM bank_events
       WHERE event_name LIKE '%transfer%' AND channel IN ('DIGITAL', 'BRANCH')
       GROUP BY event_name, channel""",
    "bank_events",
)
def filter_in_like(spark, folder):
    rows = b.bank_events(spark, folder)
    rows = rows.filter(Filter("event_name", "LIKE", "%transfer%").condition())
    rows = rows.filter(Filter("channel", "IN", ("DIGITAL", "BRANCH")).condition())
    return rows.groupBy("event_name", "channel").agg(F.count(F.lit(1)).alias("n"))


@register(
    "filter_null",
    """SELECT event_type, CASE WHEN event_amount IS NULL THEN 'null' ELSE 'known' END AS amount,
         COUNT(*) AS n
       FROM bank_events GROUP BY 1, 2""",
    "bank_events",
)
def filter_null(spark, folder):
    rows = b.bank_events(spark, folder)
    parts = [
        rows.filter(Filter("event_amount", op).condition())
        .groupBy("event_type", F.lit(name).alias("amount"))
        .agg(F.count(F.lit(1)).alias("n"))
        for op, name in (("IS NULL", "null"), ("IS NOT NULL", "known"))
    ]
    return parts[0].unionByName(parts[1])


@register(
    "filter_time_range",
    """SELECT product_type, COUNT(*) AS n, MIN(event_date) AS first_day, MAX(event_date) AS last_day
       FROM bank_orders WHERE event_date BETWEEN DATE '1996-02-01' AND DATE '1998-07-31'
       GROUP BY product_type""",
    "bank_orders",
)
def filter_time_range(spark, folder):
    span = TimeRange(dt.date(1996, 2, 1), dt.date(1998, 7, 31))
    rows = b.bank_orders(spark, folder).filter(span.condition(F.col("event_date")))
    return rows.groupBy("product_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_date").alias("first_day"),
        F.max("event_date").alias("last_day"),
    )


@register(
    "term_predicates",
    """SELECT COUNT(*) FILTER (event_amount > 0 AND event_type = 'money_movement') AS deposits,
         COUNT(*) FILTER (event_amount < 0 AND event_type = 'money_movement') AS withdrawals,
         COUNT(*) FILTER (event_type = 'money_movement') AS transactions,
         COUNT(*) FILTER (event_type = 'fee') AS fees,
         COUNT(*) FILTER (event_type = 'interest') AS interest,
         COUNT(*) FILTER (event_amount > 0 AND event_type = 'money_movement') AS inflow,
         COUNT(*) FILTER (event_amount < 0 AND event_type = 'money_movement') AS outflow,
         COUNT(*) FILTER (event_name = 'account_opened') AS accounts_opened
       FROM bank_events""",
    "bank_events",
)
def term_predicates(spark, folder):
    counts = [F.count_if(terms.predicate(t)).alias(t) for t in terms.terms()]
    return b.bank_events(spark, folder).agg(*counts)


@register(
    "time_grain",
    """SELECT strftime(event_date, '%Y-%m-%d') AS day,
         strftime(date_trunc('week', event_date), '%Y-%m-%d') AS week,
         strftime(event_date, '%Y-%m') AS month,
         year(event_date) || '-Q' || quarter(event_date) AS quarter,
         strftime(event_date, '%Y') AS year, COUNT(*) AS n
       FROM bank_orders GROUP BY ALL""",
    "bank_orders",
)
def time_grain(spark, folder):
    date = F.col("event_date")
    labels = [grain(date, u).alias(u) for u in ("day", "week", "month", "quarter", "year")]
    return b.bank_orders(spark, folder).groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


@register(
    "date_arith",
    """SELECT month(event_date) AS month_number, COUNT(*) AS n,
         CAST(MIN(event_date) - INTERVAL 90 DAY AS DATE) AS window_start,
         CAST(MAX(event_date) - INTERVAL 1 MONTH AS DATE) AS month_before
       FROM bank_orders GROUP BY 1""",
    "bank_orders",
)
def date_arith(spark, folder):
    return (
        b.bank_orders(spark, folder)
        .groupBy(F.month("event_date").alias("month_number"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.date_sub(F.min("event_date"), 90).alias("window_start"),
            F.add_months(F.max("event_date"), -1).alias("month_before"),
        )
    )


@register(
    "math_fns",
    """SELECT event_type, CAST(ABS(SUM(event_amount)) AS DOUBLE) AS magnitude,
         CAST(SUM(ROUND(event_amount, 1)) AS DOUBLE) AS rounded
       FROM bank_events GROUP BY event_type""",
    "bank_events",
)
def math_fns(spark, folder):
    amount = F.col("event_amount")
    return (
        b.bank_events(spark, folder)
        .groupBy("event_type")
        .agg(F.abs(F.sum(amount)).alias("magnitude"), F.sum(F.round(amount, 1)).alias("rounded"))
    )


@register(
    "null_fns",
    """SELECT channel,
         CAST(SUM(COALESCE(event_amount, 0)) AS DOUBLE) AS total,
         COUNT(NULLIF(event_name, 'deposit')) AS not_deposits,
         COUNT(*) FILTER (event_amount BETWEEN 10 AND 50) AS between_10_and_50,
         CAST(SUM(CAST(TRUNC(event_amount) AS BIGINT)) AS BIGINT) AS whole
       FROM bank_events GROUP BY channel""",
    "bank_events",
)
def null_fns(spark, folder):
    amount = F.col("event_amount")
    return (
        b.bank_events(spark, folder)
        .groupBy("channel")
        .agg(
            F.sum(F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))).alias("total"),
            F.count(F.nullif(F.col("event_name"), F.lit("deposit"))).alias("not_deposits"),
            F.count_if(amount.between(10, 50)).alias("between_10_and_50"),
            F.sum(amount.cast("int")).alias("whole"),
        )
    )


@register(
    "json_fields",
    """SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, COUNT(*) AS n,
         MIN('{"event_type":"' || event_type || '","k":' || regexp_extract(props, '([0-9]+)', 1) || '}')
           AS first_document
       FROM events GROUP BY 1""",
)
def json_fields(spark, folder):
    parsed = F.from_json("props", "struct<k: int>")["k"]
    rebuilt = F.to_json(F.struct("event_type", parsed.alias("k")))
    rows = b.table(spark, folder, "events")
    return rows.groupBy(parsed.cast("bigint").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min(rebuilt).alias("first_document")
    )


@register(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short
       FROM documents""",
)
def truncate_text(spark, folder):
    documents = b.table(spark, folder, "documents")
    return documents.select("doc_id", textguard.truncate(F.col("text"), 50).alias("short"))


@register(
    "json_from_text",
    """WITH bodies AS (SELECT id, trim(CASE WHEN contains(final_response, '```json')
             THEN regexp_extract(final_response, '(?s)```json(.*?)```', 1) ELSE final_response END) AS body FROM query_log)
       SELECT id, CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.n') AS BIGINT) END AS n,
         CASE WHEN json_valid(body) THEN json_extract_string(body, '$.channel') END AS channel, json_valid(body) AS parsed
       FROM bodies""",
    "query_log",
)
def json_from_text(spark, folder):
    document = textguard.json_from_text(F.col("final_response"))
    return (
        b.query_log(spark, folder)
        .withColumn("doc", document)
        .select(
            "id",
            F.try_variant_get("doc", "$.n", "bigint").alias("n"),
            F.try_variant_get("doc", "$.channel", "string").alias("channel"),
            F.col("doc").isNotNull().alias("parsed"),
        )
    )


@register(
    "count_by_dim",
    "SELECT channel, COUNT(*) AS n FROM bank_orders GROUP BY channel ORDER BY n DESC, channel",
    "bank_orders",
)
def count_by_dim(spark, folder):
    grouped = b.bank_orders(spark, folder).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return grouped.orderBy(F.desc("n"), "channel")


@register(
    "basic_aggs",
    f"""SELECT product_type, {SUM_AS_DOUBLE} AS total,
          {SUM_AS_DOUBLE} / COUNT(event_amount) AS average,
          CAST(MIN(event_amount) AS DOUBLE) AS smallest, CAST(MAX(event_amount) AS DOUBLE) AS largest
        FROM bank_orders GROUP BY product_type""",
    "bank_orders",
)
def basic_aggs(spark, folder):
    amount = "event_amount"
    return (
        b.bank_orders(spark, folder)
        .groupBy("product_type")
        .agg(
            F.sum(amount).alias("total"),
            terms.ratio(F.sum(amount), F.count(amount)).alias("average"),
            F.min(amount).alias("smallest"),
            F.max(amount).alias("largest"),
        )
    )


@register(
    "count_distinct",
    """SELECT channel, COUNT(DISTINCT customer_id) AS customers FROM bank_orders GROUP BY channel""",
    "bank_orders",
)
def count_distinct(spark, folder):
    return (
        b.bank_orders(spark, folder)
        .groupBy("channel")
        .agg(F.countDistinct("customer_id").alias("customers"))
    )


@register(
    "filtered_aggs",
    """SELECT event_name, CAST(SUM(event_amount) FILTER (channel = 'DIGITAL') AS DOUBLE) AS digital,
         CAST(SUM(event_amount) FILTER (event_type = 'interest') AS DOUBLE) AS interest,
         COUNT(*) FILTER (event_amount > 20) AS large
       FROM bank_events GROUP BY event_name""",
    "bank_events",
)
def filtered_aggs(spark, folder):
    amount = F.col("event_amount")
    return (
        b.bank_events(spark, folder)
        .groupBy("event_name")
        .agg(
            terms.sum_if(F.col("channel") == "DIGITAL", amount).alias("digital"),
            terms.sum_if(terms.predicate("interest"), amount).alias("interest"),
            F.count_if(amount > 20).alias("large"),
        )
    )


@register(
    "conditional_sums",
    """SELECT channel,
         CAST(SUM(CASE WHEN event_amount > 0 THEN event_amount ELSE 0 END) AS DOUBLE) AS money_in,
         CAST(SUM(CASE WHEN event_amount < 0 THEN ABS(event_amount) ELSE 0 END) AS DOUBLE) AS money_out,
         CAST(SUM(CASE WHEN event_type = 'interest' THEN event_amount ELSE 0 END) AS DOUBLE) AS interest
       FROM bank_events GROUP BY channel""",
    "bank_events",
)
def conditional_sums(spark, folder):
    amount = F.col("event_amount")
    return (
        b.bank_events(spark, folder)
        .groupBy("channel")
        .agg(
            terms.sum_else_zero(amount > 0, amount).alias("money_in"),
            terms.sum_else_zero(amount < 0, F.abs(amount)).alias("money_out"),
            terms.sum_else_zero(terms.predicate("interest"), amount).alias("interest"),
        )
    )


@register(
    "ratio_metric",
    """SELECT event_name,
         CAST(COUNT(*) FILTER (event_type = 'money_movement') AS DOUBLE)
           / NULLIF(COUNT(*) FILTER (event_type = 'fee'), 0) AS movements_per_fee,
         CAST(COUNT(*) FILTER (channel = 'DIGITAL') AS DOUBLE) / COUNT(*) AS digital_share
       FROM bank_events GROUP BY event_name""",
    "bank_events",
)
def ratio_metric(spark, folder):
    movements, fees = terms.predicate("transactions"), terms.predicate("fees")
    digital = F.count_if(F.col("channel") == "DIGITAL")
    return (
        b.bank_events(spark, folder)
        .groupBy("event_name")
        .agg(
            terms.ratio(F.count_if(movements), F.count_if(fees)).alias("movements_per_fee"),
            terms.ratio(digital, F.count(F.lit(1))).alias("digital_share"),
        )
    )


@register(
    "month_by_dim",
    f"""SELECT strftime(event_date, '%Y-%m') AS month, channel, COUNT(*) AS n, {SUM_AS_DOUBLE} AS total
        FROM bank_orders GROUP BY 1, 2""",
    "bank_orders",
)
def month_by_dim(spark, folder):
    return (
        b.bank_orders(spark, folder)
        .groupBy(EVENTS.month().alias("month"), "channel")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("event_amount").alias("total"))
    )


@register(
    "distinct_values",
    "SELECT DISTINCT event_name FROM bank_events ORDER BY event_name LIMIT 50",
    "bank_events",
)
def distinct_values(spark, folder):
    return profiling.distinct_values(b.bank_events(spark, folder), "event_name", 50)


@register(
    "set_ops",
    """SELECT 'union' AS op, account_id FROM
         (SELECT account_id FROM bank_orders WHERE channel = 'DIGITAL'
          UNION SELECT account_id FROM bank_orders WHERE event_type = 'fee')
       UNION ALL SELECT 'intersect', account_id FROM
         (SELECT account_id FROM bank_orders WHERE channel = 'DIGITAL'
          INTERSECT SELECT account_id FROM bank_orders WHERE event_type = 'fee')
       UNION ALL SELECT 'except', account_id FROM
         (SELECT account_id FROM bank_orders WHERE channel = 'DIGITAL'
          EXCEPT SELECT account_id FROM bank_orders WHERE event_type = 'fee')""",
    "bank_orders",
)
def set_ops(spark, folder):
    rows = b.bank_orders(spark, folder)
    digital = rows.filter(F.col("channel") == "DIGITAL").select("account_id")
    fees = rows.filter(terms.predicate("fees")).select("account_id")
    parts = {
        "union": digital.union(fees).distinct(),
        "intersect": digital.intersect(fees),
        "except": digital.subtract(fees),
    }
    named = [df.select(F.lit(op).alias("op"), "account_id") for op, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@register(
    "sql_passthrough",
    """SELECT channel, COUNT(*) AS n, CAST(SUM(event_amount) AS DOUBLE) AS total FROM bank_events
       WHERE event_type = 'money_movement' GROUP BY channel ORDER BY channel LIMIT 100""",
    "bank_events",
)
def sql_passthrough(spark, folder):
    event_source.register(b.bank_events(spark, folder))
    return event_source.query(
        spark,
        """SELECT channel, COUNT(*) AS n, CAST(SUM(event_amount) AS DOUBLE) AS total -- per channel
           FROM events WHERE event_type = 'money_movement' GROUP BY channel ORDER BY channel LIMIT 100""",
    )


@register(
    "sql_passthrough_dialect",
    """SELECT strftime(event_date, '%Y-%m') AS month, COUNT(*) AS n, COUNT(DISTINCT account_id) AS accounts
       FROM bank_events GROUP BY 1 ORDER BY 1""",
    "bank_events",
)
def sql_passthrough_dialect(spark, folder):
    event_source.register(b.bank_events(spark, folder))
    return event_source.query(
        spark,
        """SELECT strftime(event_date, '%Y-%m') AS month, COUNT(*) AS n, COUNT(DISTINCT account_id) AS accounts
           FROM 'data/sample_events.csv' GROUP BY strftime(event_date, '%Y-%m') ORDER BY month""",
    )


_JOIN = """SELECT r.r_name AS region, c.c_mktsegment AS segment, COUNT(*) AS n
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
           LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
           GROUP BY r.r_name, c.c_mktsegment ORDER BY region, segment LIMIT 100"""


@register("sql_passthrough_join", _JOIN)
def sql_passthrough_join(spark, folder):
    for name in ("customer", "nation", "region"):
        b.table(spark, folder, name).createOrReplaceTempView(name)
    return event_source.query(spark, _JOIN, GovernancePolicy(max_rows=1000))


_WINDOW = """SELECT event_name, channel, n, SUM(n) OVER (PARTITION BY event_name) AS name_total
             FROM (SELECT event_name, channel, COUNT(*) AS n FROM {t} GROUP BY event_name, channel) g
             ORDER BY event_name, channel LIMIT 150"""


@register(
    "sql_passthrough_window",
    _WINDOW.format(t="bank_events").replace(
        "SUM(n) OVER (PARTITION BY event_name)",
        "CAST(SUM(n) OVER (PARTITION BY event_name) AS BIGINT)",
    ),
    "bank_events",
)
def sql_passthrough_window(spark, folder):
    event_source.register(b.bank_events(spark, folder))
    # Small groups are shown here, as the SQL beside it shows them.
    return event_source.query(spark, _WINDOW.format(t="events"), GovernancePolicy(entity=None))


@register(
    "sql_bounded_export",
    """WITH days AS (SELECT event_date, COUNT(*) AS n FROM bank_orders GROUP BY event_date HAVING COUNT(DISTINCT account_id) >= 2)
       SELECT strftime(event_date, '%Y-%m-%d') AS day, n, (SELECT COUNT(*) FROM days) AS total_rows, true AS truncated
       FROM days ORDER BY event_date LIMIT 20""",
    "bank_orders",
)
def sql_bounded_export(spark, folder):
    """The first rows of a query as a local table, and how many there were."""
    event_source.register(b.bank_orders(spark, folder))
    text = "SELECT date_format(event_date, 'yyyy-MM-dd') AS day, COUNT(*) AS n FROM events GROUP BY event_date ORDER BY event_date"
    frame = event_source.query_pandas(spark, text, GovernancePolicy(k=2, max_rows=20))
    marks = {c: F.lit(frame.attrs[c]) for c in ("total_rows", "truncated")}
    return spark.createDataFrame(frame).withColumns(marks)


_SMALL = """SELECT {day} AS day, event_name, channel, COUNT(*) AS n, CAST(SUM(event_amount) AS DOUBLE) AS total
            FROM {t} GROUP BY event_date, event_name, channel {having} ORDER BY day, event_name, channel"""


@register(
    "sql_threshold",
    _SMALL.format(day="strftime(event_date, '%Y-%m-%d')", t="bank_events", having="HAVING COUNT(DISTINCT account_id) >= 5"),
    "bank_events",
)
def sql_threshold(spark, folder):
    """The text names no threshold; small groups are removed all the same."""
    event_source.register(b.bank_events(spark, folder))
    return event_source.query(spark, _SMALL.format(day="date_format(event_date, 'yyyy-MM-dd')", t="events", having=""))


@register(
    "sql_threshold_steps",
    """WITH daily AS (SELECT event_date, channel, COUNT(*) AS n FROM bank_events WHERE event_type = 'money_movement'
           GROUP BY event_date, channel HAVING COUNT(DISTINCT account_id) >= 40),
         active AS (SELECT channel, account_id, COUNT(*) AS events FROM bank_events GROUP BY channel, account_id),
         per_account AS (SELECT channel, CAST(AVG(events) AS DOUBLE) AS events FROM active
           GROUP BY channel HAVING COUNT(DISTINCT account_id) >= 40)
       SELECT d.channel, COUNT(*) AS days, CAST(SUM(d.n) AS BIGINT) AS n, round(MAX(p.events), 9) AS per_account
       FROM daily d JOIN per_account p ON d.channel = p.channel GROUP BY d.channel""",
    "bank_events",
)
def sql_threshold_steps(spark, folder):
    """Groupings in steps, of which one passes by single accounts on its way."""
    event_source.register(b.bank_events(spark, folder))
    return event_source.query(
        spark,
        """WITH moved AS (SELECT event_date, channel FROM events WHERE event_type = 'money_movement'),
             daily AS (SELECT event_date, channel, COUNT(*) AS n FROM moved GROUP BY event_date, channel),
             active AS (SELECT channel, account_id, COUNT(*) AS events FROM events GROUP BY channel, account_id),
             per_account AS (SELECT channel, AVG(events) AS events FROM active GROUP BY channel)
           SELECT d.channel, COUNT(*) AS days, SUM(d.n) AS n, round(MAX(p.events), 9) AS per_account
           FROM daily d JOIN per_account p ON d.channel = p.channel GROUP BY d.channel""",
        GovernancePolicy(k=40),
    )


_BROKEN_LINES = "event_id % 97 = 0"


@register(
    "csv_checked",
    f"""SELECT event_type, COUNT(*) AS n, CAST(SUM(event_amount) AS DOUBLE) AS total FROM bank_events GROUP BY event_type
       UNION ALL SELECT 'rejected: ' || kind, COUNT(*), NULL FROM (
         SELECT unnest(['few', 'many', 'value']) AS kind FROM bank_events WHERE {_BROKEN_LINES}) GROUP BY kind""",
    "bank_events",
)
def csv_checked(spark, folder):
    """The events written as CSV and read again, with lines in between that are no events."""
    rows = b.bank_events(spark, folder).select(*EVENT_STRUCT.names)
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).csv(path)
    field = F.concat(F.lit("x"), F.col("event_id").cast("string"))
    ends = [",few", ",few" * 20, ",not a time" + "," * (len(EVENT_STRUCT) - 2)]
    lines = rows.filter(_BROKEN_LINES).select(F.explode(F.array(*[F.concat(field, F.lit(e)) for e in ends])).alias("line"))
    # The first line of every CSV file is a header.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.when(first, F.lit(",".join(EVENT_STRUCT.names) + "\n")).otherwise("")
    lines.select(F.concat(header, "line").alias("line")).write.mode("append").text(path)
    good, rejected = event_source.read_csv_checked(spark, path)
    kind = F.when(F.col("line").contains("not a time"), "value").when(F.col("line").contains(",few,few"), "many").otherwise("few")
    counted = rejected.groupBy(F.concat(F.lit("rejected: "), kind).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    amounts = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_amount").alias("total"))
    return amounts.unionByName(counted.withColumn("total", F.lit(None).cast("decimal(28,2)")))


@register(
    "governed_limit",
    """SELECT event_date, channel, COUNT(*) AS n FROM bank_orders GROUP BY 1, 2
       ORDER BY event_date, channel LIMIT 100""",
    "bank_orders",
)
def governed_limit(spark, folder):
    policy = GovernancePolicy()
    grouped = b.bank_orders(spark, folder).groupBy("event_date", "channel")
    counted = grouped.agg(F.count(F.lit(1)).alias("n"))
    return policy.check_columns(counted.orderBy("event_date", "channel").limit(policy.limit))
