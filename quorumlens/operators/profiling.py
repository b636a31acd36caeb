"""Table facts, value discovery, conformance to enums and business rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens import fixed_values as fixed
from quorumlens.plans.schema import EVENTS, EventSchema, latest
from quorumlens.policy import GovernancePolicy


def table_info(df: DataFrame, date: str) -> DataFrame:
    """One row: row count, first and last date, and the columns with their types."""
    columns = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
    ).withColumn("columns", F.lit(columns))


def date_range(df: DataFrame, date: str) -> DataFrame:
    """First date, last date and number of distinct dates."""
    return df.agg(
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.countDistinct(date).alias("num_days"),
    )


def _pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of several columns from one scan, without nulls."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value) for several columns in one pass; nulls are left out."""
    return _pairs(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def discover(
    df: DataFrame,
    columns: Sequence[str],
    date: str,
    policy: GovernancePolicy = GovernancePolicy(),
) -> DataFrame:
    """Most frequent values of categorical columns in the last days of the data.

    The window ends at the newest date of the whole table. Columns that may not be listed are
    skipped. The rank filter is applied before the shuffle as well, so a column with very many
    values sends only its best rows to the final task.
    """
    allowed = [c for c in columns if c in fixed.DISCOVERABLE_COLUMNS]
    if not allowed:
        schema = "column string, value string, cnt bigint, rank int"
        return df.sparkSession.createDataFrame([], schema)
    recent = df.filter(F.col(date) >= F.date_sub(latest(df, date), policy.window_days))
    order = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
    ranked = value_counts(recent, allowed).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= policy.discovery_limit)


def columns_to_discover(definition: Mapping[str, Any]) -> list[str]:
    """Listable columns named by a definition's dimensions and filters; ``event_type`` always."""
    filters = definition.get("filters") or []
    named = list(definition.get("dimensions") or [])
    if isinstance(filters, Mapping):
        named += list(filters)
    else:
        for item in filters:
            if isinstance(item, Mapping):
                named.append(item.get("column", ""))
            elif item.split():
                named.append(item.split()[0].strip("'\""))
    wanted = {*named, "event_type"}
    return [c for c in fixed.DISCOVERABLE_COLUMNS if c in wanted]


def discovery_notes(discovered: DataFrame) -> DataFrame:
    """Per column: number of values found and the first five, as a sentence."""
    return _value_list(discovered, 5).select(
        "column",
        F.format_string(
            "Found %d distinct values for '%s': [%s]%s",
            "n_values",
            "column",
            "shown",
            F.when(F.col("n_values") > 5, "...").otherwise(""),
        ).alias("note"),
    )


def discovery_context(discovered: DataFrame) -> DataFrame:
    """Per column: up to ten quoted values, with the total when there are more."""
    more = F.when(
        F.col("n_values") > 10, F.format_string(" ... (%d total)", "n_values")
    ).otherwise("")
    return _value_list(discovered, 10).select(
        F.col("column"), F.concat("shown", more).alias("values")
    )


def _value_list(discovered: DataFrame, n: int) -> DataFrame:
    """Bounded lists: discovery keeps at most ``discovery_limit`` values of a column."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "value")))
    quoted = F.transform(
        F.slice(ranked, 1, n), lambda v: F.concat(F.lit("'"), v["value"], F.lit("'"))
    )
    return discovered.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.array_join(quoted, ", ").alias("shown")
    )


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The first values of a column in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit)


def enum_conformance(df: DataFrame, enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values outside their enum with row counts, and enum values that never occur.

    The expected values join the data's own values as rows, so one scan and one shuffle of partial
    counts find both.
    """
    listed = [(c, v) for c, values in enums.items() for v in values]
    expected = df.sparkSession.createDataFrame(listed, "column string, value string")
    both = _pairs(df, list(enums)).withColumn("seen", F.lit(1)).unionByName(
        expected.withColumn("seen", F.lit(0))
    )
    judged = both.groupBy("column", "value").agg(
        F.sum("seen").alias("cnt"), F.min("seen").alias("first")
    )
    issue = F.when(F.col("first") == 1, "unexpected").when(F.col("cnt") == 0, "missing")
    return judged.select("column", "value", issue.alias("issue"), "cnt").filter(
        F.col("issue").isNotNull()
    )


def event_rules(schema: EventSchema = EVENTS) -> dict[str, Column]:
    """Violation predicates of the business rules of an event table."""
    amount = F.col(schema.amount)
    name = F.col(schema.event_name)
    monetary = F.col(schema.event_type).isin("money_movement", "interest", "fee")
    return {
        "date_matches_timestamp": F.col(schema.date) != F.to_date(F.col(schema.ts)),
        "outflow_is_negative": name.isin("withdrawal", "payment", "transfer_out") & (amount > 0),
        "inflow_is_positive": name.isin("deposit", "transfer_in") & (amount < 0),
        "monetary_has_amount": monetary & amount.isNull(),
        "non_monetary_has_no_amount": (F.col(schema.event_type) == "account_status")
        & amount.isNotNull(),
    }


def rule_violations(
    df: DataFrame, rules: Mapping[str, Column], unique: str | None = None
) -> DataFrame:
    """Violations per rule in one pass without a shuffle of rows.

    ``unique`` adds the number of surplus rows of repeated key values; only the key column is shuffled.
    """
    counts = [F.count_if(violated).alias(rule) for rule, violated in rules.items()]
    found = df.agg(*counts).unpivot([], list(rules), "rule", "violations")
    if unique is None:
        return found
    per_key = df.filter(F.col(unique).isNotNull()).groupBy(unique).agg(F.count(F.lit(1)).alias("n"))
    surplus = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return found.unionByName(surplus.select(F.lit(f"unique_{unique}").alias("rule"), "violations"))


def balance_continuity(
    df: DataFrame,
    account: str,
    order: Sequence[str],
    amount: str,
    balance: str,
    bucket: Column,
    dims: Sequence[Column] = (),
) -> DataFrame:
    """Breaks of ``balance = previous balance + amount`` along each account, counted per dims.

    ``bucket`` must never decrease along ``order``, for example the hour of the timestamp. It splits
    one account over many tasks: inside a bucket the previous balance comes from ``lag``; the first
    row of a bucket takes the last balance of the account's previous bucket, which is found on one
    row per account and bucket.
    """
    rows = df.withColumn("bucket_", bucket)
    inside = Window.partitionBy(account, "bucket_").orderBy(*order)
    lagged = rows.withColumn("row_", F.row_number().over(inside)).withColumn(
        "lag_", F.lag(balance).over(inside)
    )
    edges = rows.groupBy(account, "bucket_").agg(
        F.max_by(F.struct(F.col(balance).alias("balance")), F.struct(*order)).alias("last_")
    )
    along = Window.partitionBy(account).orderBy("bucket_")
    carried = edges.select(account, "bucket_", F.lag("last_").over(along).alias("carried_"))
    # one carried row per account and bucket, on the partitioning the window already has
    joined = lagged.join(carried, [account, "bucket_"])
    first = F.col("row_") == 1
    previous = F.when(first, F.col("carried_.balance")).otherwise(F.col("lag_"))
    has_previous = ~first | F.col("carried_").isNotNull()
    checked = joined.withColumn("previous_", previous).withColumn("has_previous_", has_previous)
    known = F.col("has_previous_") & F.col("previous_").isNotNull()
    broken = known & (F.col(balance) != F.col("previous_") + F.col(amount))
    return checked.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(known).alias("n_checked"),
        F.count_if(broken).alias("n_breaks"),
    )


def account_fanout(df: DataFrame, customer: str, account: str) -> DataFrame:
    """How many customers have how many accounts; no identifier leaves the aggregation."""
    per_customer = df.groupBy(customer).agg(F.countDistinct(account).alias("accounts"))
    return per_customer.groupBy("accounts").agg(F.count(F.lit(1)).alias("customers"))
