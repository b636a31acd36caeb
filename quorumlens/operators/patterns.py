"""Named query patterns of the semantic layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions import terms
from quorumlens.operators.privacy import k_anon
from quorumlens.plans.schema import EVENTS, EventSchema, latest
from quorumlens.policy import GovernancePolicy, cut


def _movements(df: DataFrame, s: EventSchema) -> DataFrame:
    return df.filter(terms.predicate("transactions", s))


def daily_summary(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """Money movements per date: events, money in and money out."""
    amount = F.col(s.amount)
    return (
        _movements(df, s)
        .groupBy(s.date)
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            terms.sum_else_zero(amount > 0, amount).alias("deposits"),
            F.abs(terms.sum_else_zero(amount < 0, amount)).alias("withdrawals"),
        )
        .orderBy(s.date)
    )


def product_mix(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """Accounts, events and summed amount per product, over all event types."""
    return df.groupBy(s.product).agg(
        F.countDistinct(s.account).alias("accounts"),
        F.count(F.lit(1)).alias("events"),
        F.sum(s.amount).alias("net_flow"),
    )


def share_of_total(grouped: DataFrame, count: str, name: str, digits: int = 2) -> DataFrame:
    """Add each group's percentage of the summed ``count`` (exact decimal, rounded half up).

    The total is a scalar subquery over the same aggregate, whose shuffle Spark reuses; no window
    without partitions gathers all groups in one task.
    """
    total = grouped.agg(F.sum(count)).scalar()
    exact = F.lit(100).cast("decimal(18,0)") * F.col(count).cast("decimal(18,0)")
    quotient = F.try_divide(exact, total.cast("decimal(18,0)"))
    return grouped.withColumn(name, F.round(quotient, digits))


def channel_share(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """Money movements per channel with the share of all, largest first."""
    grouped = _movements(df, s).groupBy(s.channel).agg(F.count(F.lit(1)).alias("transactions"))
    return share_of_total(grouped, "transactions", "pct").orderBy(F.desc("transactions"), s.channel)


def top_entities(df: DataFrame, n: int = 10, s: EventSchema = EVENTS) -> DataFrame:
    """Most active customers. It shows identifiers, so it is an internal step, never an answer."""
    return (
        _movements(df, s)
        .groupBy(s.customer)
        .agg(F.count(F.lit(1)).alias("event_count"), F.sum(s.amount).alias("net_flow"))
        .orderBy(F.desc("event_count"), s.customer)
        .limit(n)
    )


def monthly(
    df: DataFrame,
    measures: Sequence[Column],
    dims: Sequence[str] = (),
    policy: GovernancePolicy = GovernancePolicy(),
    s: EventSchema = EVENTS,
) -> DataFrame:
    """k-anonymous measures per month and further dims."""
    return k_anon(df, [s.month().alias("month"), *dims], measures, s.entity, policy.k)


def monthly_net_flow(
    df: DataFrame,
    product: str | None = None,
    policy: GovernancePolicy = GovernancePolicy(),
    s: EventSchema = EVENTS,
) -> DataFrame:
    """Net flow per month and product (or of one product), k-anonymous."""
    rows = _movements(df, s)
    if product is not None:
        rows = rows.filter(F.col(s.product) == product)
    result = monthly(rows, [F.sum(s.amount).alias("net_flow")], [s.product], policy, s)
    return result.orderBy("month", s.product)


def monthly_volume(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """Money movements per month."""
    return (
        _movements(df, s)
        .groupBy(s.month().alias("month"))
        .agg(F.count(F.lit(1)).alias("transactions"))
        .orderBy("month")
    )


def _flows(s: EventSchema) -> list[Column]:
    return [
        terms.sum_else_zero(terms.predicate("inflow", s), F.col(s.amount)).alias("inflow"),
        terms.sum_else_zero(terms.predicate("outflow", s), -F.col(s.amount)).alias("outflow"),
    ]


def inflow_outflow(
    df: DataFrame,
    policy: GovernancePolicy = GovernancePolicy(),
    s: EventSchema = EVENTS,
) -> DataFrame:
    """Money in and money out side by side per month and product, k-anonymous."""
    result = monthly(_movements(df, s), _flows(s), [s.product], policy, s)
    return result.orderBy("month", s.product)


def default_trend(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """Answer to an open trend question: per month events, money in, money out and net flow."""
    return (
        _movements(df, s)
        .groupBy(s.month().alias("month"))
        .agg(F.count(F.lit(1)).alias("transactions"), *_flows(s))
        .withColumn("net_flow", F.col("inflow") - F.col("outflow"))
        .orderBy("month")
    )


def recent(df: DataFrame, months: int = 3, s: EventSchema = EVENTS) -> DataFrame:
    """Rows of the last months of the data, counted back from its newest date, not from today."""
    return df.filter(F.col(s.date) > F.add_months(latest(df, s.date), -months))


def last_complete_month(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """Rows of the newest month whose last day is in the data."""
    newest = latest(df, s.date)
    start = F.when(newest == F.last_day(newest), F.trunc(newest, "month")).otherwise(
        F.add_months(F.trunc(newest, "month"), -1)
    )
    return df.filter((F.col(s.date) >= start) & (F.col(s.date) <= F.last_day(start)))


def latest_year(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """Rows of the newest calendar year in the data."""
    return df.filter(F.col(s.date) >= F.trunc(latest(df, s.date), "year"))


def average_balance(
    df: DataFrame,
    group: str,
    balance: str,
    entity: str,
    policy: GovernancePolicy = GovernancePolicy(),
) -> DataFrame:
    """Average balance per group, k-anonymous, highest first."""
    average = terms.ratio(F.sum(balance), F.count(balance)).alias("avg_balance")
    return k_anon(df, [group], [average], entity, policy.k).orderBy(F.desc("avg_balance"), group)


def safe_summary(
    df: DataFrame,
    dims: Sequence[str],
    policy: GovernancePolicy = GovernancePolicy(),
    s: EventSchema = EVENTS,
    limit: int | None = None,
) -> DataFrame:
    """Summary given in place of raw rows; with a ``limit`` it says how many groups there were."""
    aggs = [F.count(F.lit(1)).alias("events"), F.sum(s.amount).alias("total_amount")]
    summary = k_anon(df, dims, aggs, s.entity, policy.k, keep_entities=True)
    return cut(summary.orderBy(F.desc("events"), *dims), limit)


def channel_compare(
    df: DataFrame, channels: Sequence[str], s: EventSchema = EVENTS
) -> DataFrame:
    """Money movements per month with one column per channel, and the busiest channel.

    The channel list is given, so the pivot needs no extra pass to find it.
    """
    counts = [F.count_if(F.col(s.channel) == c).alias(c) for c in channels]
    table = _movements(df, s).groupBy(s.month().alias("month")).agg(*counts)
    highest = F.greatest(*channels) if len(channels) > 1 else F.col(channels[0])
    busiest = F.coalesce(*[F.when(F.col(c) == highest, c) for c in channels])
    return table.withColumn("busiest", busiest).orderBy("month")


def month_over_month(
    df: DataFrame, dims: Sequence[str], s: EventSchema = EVENTS
) -> DataFrame:
    """Net flow per month with the change from the month before, within each dims value."""
    table = (
        _movements(df, s)
        .groupBy(*dims, s.month().alias("month"))
        .agg(F.sum(s.amount).alias("net_flow"))
    )
    before = F.lag("net_flow").over(Window.partitionBy(*dims).orderBy("month"))
    change = F.col("net_flow") - F.col("previous")
    return table.withColumn("previous", before).select(
        *dims,
        "month",
        "net_flow",
        "previous",
        change.alias("change"),
        terms.ratio(F.lit(100) * change, F.abs("previous")).alias("change_pct"),
    )


def trend_drivers(df: DataFrame, dim: str, s: EventSchema = EVENTS) -> DataFrame:
    """Each dimension value's change from month to month and its share of the month's change."""
    change = month_over_month(df, [dim], s).filter(F.col("previous").isNotNull())
    whole = F.sum("change").over(Window.partitionBy("month"))
    share = terms.ratio(F.lit(100) * F.col("change"), F.col("month_change"))
    return (
        change.withColumn("month_change", whole)
        .withColumn("share_pct", share)
        .select(dim, "month", "change", "month_change", "share_pct")
    )


def answer_mapped_questions(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    """The global answers of the known question templates, from one pass over the table."""
    deposits = terms.predicate("deposits", s)
    answers = {
        "How much money was deposited?": terms.sum_if(deposits, F.col(s.amount)),
        "What's the transaction volume?": F.count_if(terms.predicate("transactions", s)),
        "What fees were charged?": terms.sum_if(terms.predicate("fees", s), F.col(s.amount)),
        "How many accounts were opened?": F.count_if(terms.predicate("accounts_opened", s)),
    }
    aggs = [a.cast("decimal(38,2)").alias(f"a{i}") for i, a in enumerate(answers.values())]
    return df.agg(*aggs).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(q).alias("question"), F.col(f"a{i}").alias("answer"))
                    for i, q in enumerate(answers)
                ]
            )
        )
    )


def daily_deposit_trend(df: DataFrame, s: EventSchema = EVENTS) -> DataFrame:
    return (
        df.filter(terms.predicate("deposits", s))
        .groupBy(s.date)
        .agg(F.sum(s.amount).alias("deposits"))
        .orderBy(s.date)
    )


def preview(result: DataFrame, max_rows: int = 10) -> DataFrame:
    """First rows of a result, in the text order of its first date-like column if it has one."""
    names = ("month", "date", "event_date", "year", "quarter", "week")
    dated = [c for c in result.columns if c in names]
    first = [F.coalesce(F.col(dated[0]).cast("string"), F.lit(""))] if dated else []
    rest = [F.col(c) for c in result.columns if c not in dated[:1]]
    return result.orderBy(*first, *rest).limit(max_rows)
