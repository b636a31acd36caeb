"""Data-quality checks of a result table, all with the shape (check, status, message, details).

Results are the output of governed aggregation, so they are small by policy; the checks still run as
one aggregate over the table and never collect rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.functions import terms
from quorumlens.operators import privacy, ranks
from quorumlens.policy import GovernancePolicy

CHECK_SCHEMA = "check string, status string, message string, details string"

_SEVERITY = {"pass": 0, "warning": 1, "fail": 2}


def _columns_of(result: DataFrame, kinds: tuple[type, ...]) -> list[str]:
    return [f.name for f in result.schema.fields if isinstance(f.dataType, kinds)]


def null_counts(result: DataFrame) -> DataFrame:
    """Columns that contain nulls, with count and rate, from one pass."""
    columns = list(result.columns)
    totals = result.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nulls"))
        for i, c in enumerate(columns)
    ]
    return (
        totals.select("n_rows", F.inline(F.array(*entries)))
        .filter(F.col("nulls") > 0)
        .select("column", "nulls", terms.ratio(F.col("nulls"), F.col("n_rows")).alias("null_rate"))
    )


def null_rate(result: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Columns whose share of nulls is above the threshold."""
    return null_counts(result).filter(F.col("null_rate") > threshold)


def negative_counts(result: DataFrame, count_columns: Sequence[str] | None = None) -> DataFrame:
    """Count columns with negative values. Every numeric type is checked, decimals included."""
    wanted = count_columns or [c for c in result.columns if "count" in c.lower()]
    columns = [c for c in _columns_of(result, (T.NumericType,)) if c in wanted]
    if not columns:
        return result.sparkSession.createDataFrame([], "column string, negatives bigint")
    counts = [F.count_if(F.col(c) < 0).alias(c) for c in columns]
    return result.agg(*counts).unpivot([], columns, "column", "negatives").filter("negatives > 0")


def row_cap(result: DataFrame, policy: GovernancePolicy = GovernancePolicy()) -> DataFrame:
    """The row_count check alone, with the number of all rows."""
    n = F.count(F.lit(1))
    large = F.concat(
        F.lit("Large result set ("), "n", F.lit(f" rows) exceeds recommended limit of {policy.max_rows}")
    )
    return result.agg(n.alias("n")).select(
        F.lit("row_count").alias("check"),
        F.when(F.col("n") > policy.max_rows, "warning").otherwise("pass").alias("status"),
        F.when(F.col("n") > policy.max_rows, large)
        .when(F.col("n") == 1, F.lit("Single aggregate result"))
        .otherwise(F.concat(F.lit("Row count ("), F.col("n"), F.lit(") is reasonable")))
        .alias("message"),
    )


def outliers(
    result: DataFrame,
    column: str,
    dims: Sequence[str] = (),
    method: str = "iqr",
    factor: float | None = None,
) -> DataFrame:
    """Rows far from the rest of their group.

    ``iqr`` uses exact quartiles, found by :func:`ranks.quantiles` in a few jobs while this is called; a group of
    any size is spread over all tasks. ``zscore`` needs counts and sums only and starts no job. Rows without a
    value are left out; NaN and infinities count for no quartile and lie outside.
    """
    value = F.col(column).cast("double")
    known = result.filter(F.col(column).isNotNull())
    if method == "iqr":
        reach = 1.5 if factor is None else factor
        bounds = ranks.quantiles(known, value, dims, (0.25, 0.75))
        q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    elif method == "zscore":
        reach = 3.0 if factor is None else factor
        bounds = known.groupBy(*dims).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
    else:
        raise ValueError(f"unknown outlier method: {method}")
    low, high = (q1 - F.lit(reach) * (q3 - q1), q3 + F.lit(reach) * (q3 - q1)) if method == "iqr" else (
        F.col("m") - F.lit(reach) * F.col("sd"), F.col("m") + F.lit(reach) * F.col("sd")
    )
    bounds = bounds.select(*dims, low.alias("low"), high.alias("high"))
    if not dims:
        low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
        return known.withColumn("low", low).withColumn("high", high).filter((value < F.col("low")) | (value > F.col("high")))
    joined = ranks.with_group(known, bounds, dims, ("low", "high"))
    return joined.filter((value < F.col("low")) | (value > F.col("high")))


def percentages_in_range(result: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of percentage columns outside 0..100."""
    counts = [F.count_if(~F.col(c).between(0, 100)).alias(c) for c in columns]
    return result.agg(*counts).unpivot([], list(columns), "column", "out_of_range")


def reconcile(df: DataFrame, dims: Sequence[str], measure: str) -> DataFrame:
    """Whether the grouped sums add up to the ungrouped sum; each side is a scan of its own."""
    parts = df.groupBy(*dims).agg(F.sum(measure).alias("part"))
    whole = df.agg(F.sum(measure)).scalar()
    return parts.agg(F.sum("part").alias("sum_of_parts")).select(
        "sum_of_parts", whole.alias("total"), (F.col("sum_of_parts") == whole).alias("reconciles")
    )


def hidden_by_k(sql_text: str | None) -> bool:
    """An empty result is probably the threshold's doing when the query filters on distinct counts."""
    return "HAVING COUNT(DISTINCT" in (sql_text or "").upper()


def report(
    result: DataFrame | None,
    sql_text: str | None = None,
    policy: GovernancePolicy = GovernancePolicy(),
    count_columns: Sequence[str] | None = None,
) -> DataFrame:
    """All checks of a result plus an ``overall`` row. The table is read once, by one aggregate."""
    if result is None:
        return _missing_result()
    counts = list(count_columns or [c for c in result.columns if privacy.is_count_like(c)])
    numeric = _columns_of(result, (T.NumericType,))
    negative_in = [c for c in numeric if "count" in c.lower()]
    small = F.lit(0).cast("bigint")
    for c in numeric:
        if c in counts:
            small = small + F.count_if(F.col(c) < policy.k)
    one = result.agg(
        F.count(F.lit(1)).alias("rows"),
        small.alias("small"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(result.columns)],
        *[F.count_if(F.col(c) < 0).alias(f"negative_{i}") for i, c in enumerate(negative_in)],
    )
    nulls = {c: F.col(f"nulls_{i}") for i, c in enumerate(result.columns)}
    negatives = {c: F.col(f"negative_{i}") for i, c in enumerate(negative_in)}
    found = policy.forbidden_in(result.columns)
    checks = one.select(
        F.inline(F.array(*_checks(nulls, negatives, found, hidden_by_k(sql_text), policy)))
    )
    return checks.unionByName(_overall(checks))


def _missing_result() -> DataFrame:
    row = ("overall", "fail", "No SQL result to validate", None)
    return SparkSession.active().createDataFrame([row], CHECK_SCHEMA)


def _row(check: str, status: Column, message: Column, details: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        status.alias("status"),
        message.alias("message"),
        details.cast("string").alias("details"),
    )


def _checks(
    nulls: dict[str, Column],
    negatives: dict[str, Column],
    forbidden: list[str],
    hidden: bool,
    policy: GovernancePolicy,
) -> list[Column]:
    rows, none = F.col("rows"), F.lit(None)
    empty = rows == 0
    no_data = F.lit("No data to check")

    def level(bad: Column) -> Column:
        return F.when(bad, "warning").otherwise("pass")

    privacy_text = (
        "Query returned no results - likely due to privacy thresholds "
        f"(fewer than {policy.k} distinct accounts in each bucket)"
    )
    nothing = privacy_text if hidden else "Query returned no results"
    cause = F.lit("k_anonymity_filter" if hidden else None)
    has_data = _row(
        "has_data",
        level(empty),
        F.when(empty, nothing).otherwise(F.concat(F.lit("Query returned "), rows, F.lit(" rows"))),
        F.when(empty, cause).otherwise(none),
    )
    with_nulls = F.lit(0)
    for n in nulls.values():
        with_nulls = with_nulls + (n > 0).cast("int")
    null_list = [F.when(n > 0, F.concat(F.lit(f"{c}="), n)) for c, n in nulls.items()]
    null_check = _row(
        "null_check",
        level(with_nulls > 0),
        F.when(empty, no_data)
        .when(
            with_nulls > 0,
            F.concat(F.lit("Found null values in "), with_nulls, F.lit(" column(s)")),
        )
        .otherwise("No null values found"),
        F.nullif(F.concat_ws(", ", *null_list), F.lit("")),
    )
    too_many = rows > policy.max_rows
    large = F.concat(
        F.lit("Large result set ("),
        rows,
        F.lit(f" rows) exceeds recommended limit of {policy.max_rows}"),
    )
    row_count = _row(
        "row_count",
        level(too_many),
        F.when(too_many, large)
        .when(rows == 1, "Single aggregate result")
        .otherwise(F.concat(F.lit("Row count ("), rows, F.lit(") is reasonable"))),
        rows,
    )
    negative_list = [
        F.when(n > 0, F.concat(F.lit(f"Column '{c}' has "), n, F.lit(" negative value(s)")))
        for c, n in negatives.items()
    ]
    issues = F.concat_ws("; ", *negative_list)
    numeric_check = _row(
        "numeric_check",
        level(issues != ""),
        F.when(empty, no_data)
        .when(issues != "", issues)
        .otherwise("Numeric values look reasonable"),
        none,
    )
    small = F.col("small")
    k_check = _row(
        "privacy_k_anonymity",
        level(small > 0),
        F.when(empty, no_data)
        .when(small > 0, F.concat(F.lit("Found "), small, F.lit(f" bucket(s) with count < {policy.k}")))
        .otherwise(f"All buckets meet k-anonymity threshold (>= {policy.k})"),
        small,
    )
    violation = f"PRIVACY VIOLATION: Forbidden columns in output: {forbidden}"
    forbidden_check = _row(
        "forbidden_columns",
        F.lit("fail" if forbidden else "pass"),
        F.lit(violation if forbidden else "No forbidden columns in output"),
        F.lit(", ".join(forbidden) or None),
    )
    return [has_data, null_check, row_count, numeric_check, k_check, forbidden_check]


def _overall(checks: DataFrame) -> DataFrame:
    """Worst status of all checks; its details name the checks that raised it."""
    severity = F.lit(0)
    for status, value in _SEVERITY.items():
        severity = F.when(F.col("status") == status, value).otherwise(severity)
    raised = F.sort_array(F.collect_set(F.when(severity > 0, F.col("check"))))
    return checks.agg(F.max(severity).alias("worst"), raised.alias("raised")).select(
        F.lit("overall").alias("check"),
        F.element_at(F.array(*[F.lit(s) for s in _SEVERITY]), F.col("worst") + 1).alias("status"),
        F.when(F.col("worst") == 2, "Data quality checks failed")
        .when(F.col("worst") == 1, "Data quality checks passed with warnings")
        .otherwise("All data quality checks passed")
        .alias("message"),
        F.nullif(F.array_join("raised", ", "), F.lit("")).alias("details"),
    )
