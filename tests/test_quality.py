from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens import GovernancePolicy
from quorumlens.operators import profiling, quality, ranks
from tests.conftest import rows

RESULT = "channel string, total double, unique_customers bigint"


def _status(report):
    return {r.check: (r.status, r.message) for r in report.collect()}


def test_clean_result_passes(spark):
    df = spark.createDataFrame([("A", 1.0, 9), ("B", 2.0, 8)], RESULT)
    got = _status(quality.report(df))
    assert got["overall"] == ("pass", "All data quality checks passed")
    assert got["row_count"][1] == "Row count (2) is reasonable"


def test_empty_result_names_the_threshold(spark):
    df = spark.createDataFrame([], RESULT)
    got = _status(quality.report(df, "select 1 having count(distinct account_id) >= 7", GovernancePolicy(k=7)))
    assert got["has_data"][0] == "warning" and "fewer than 7 distinct accounts" in got["has_data"][1]
    assert got["null_check"][1] == "No data to check"
    assert _status(quality.report(df))["has_data"][1] == "Query returned no results"


def test_missing_result_fails(spark):
    assert _status(quality.report(None))["overall"][0] == "fail"


def test_identifier_column_fails_the_report(spark):
    df = spark.createDataFrame([(1, 9)], "Customer_ID int, n int")
    got = _status(quality.report(df))
    assert got["overall"][0] == "fail" and "Customer_ID" in got["forbidden_columns"][1]


def test_row_limit(spark):
    wide = spark.range(201).withColumnRenamed("id", "n")
    assert _status(quality.report(wide))["row_count"][0] == "warning"
    assert quality.row_cap(wide).first().status == "warning"
    large = quality.row_cap(spark.range(5000)).first().message
    assert large == "Large result set (5000 rows) exceeds recommended limit of 200"
    assert quality.row_cap(spark.range(1)).first().message == "Single aggregate result"


def test_negative_counts_include_decimals(spark):
    df = spark.createDataFrame([(Decimal("-1.00"), -5)], "event_count decimal(9,2), total int")
    assert rows(quality.negative_counts(df)) == [("event_count", 1)]
    assert _status(quality.report(df))["numeric_check"][1] == "Column 'event_count' has 1 negative value(s)"


def test_small_cell_at_the_threshold(spark):
    df = spark.createDataFrame([(5,), (4,)], "unique_customers int")
    assert _status(quality.report(df))["privacy_k_anonymity"][1] == "Found 1 bucket(s) with count < 5"


def test_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "d string, n int")
    assert rows(quality.null_counts(df)) == [("d", 1, 1 / 3)]
    assert rows(quality.null_rate(df, 0.5)) == []


def test_outliers_by_both_methods(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(50)] + [(500.0,)], "x double")
    for method in ("iqr", "zscore"):
        assert [r.x for r in quality.outliers(df, "x", method=method).collect()] == [500.0]


def test_discovery_window_is_inclusive_and_skips_other_columns(spark):
    df = spark.createDataFrame(
        [("A", 1, "2024-04-10"), ("B", 1, "2024-01-11"), ("C", 1, "2024-01-10"), (None, 1, "2024-04-10")],
        "channel string, account_id int, d string",
    ).withColumn("event_date", F.to_date("d"))
    got = profiling.discover(df, ["channel", "account_id"], "event_date").collect()
    assert {r.value for r in got} == {"A", "B"}  # 90 days before April 10 is January 11


def test_discovery_ties_and_limit(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "channel string").withColumn(
        "event_date", F.current_date()
    )
    got = profiling.discover(df, ["channel"], "event_date", GovernancePolicy(discovery_limit=2))
    assert [r.value for r in got.orderBy("rank").collect()] == ["c", "a"]


def test_columns_to_discover_from_all_filter_forms():
    forms = ({"channel": "= 'A'"}, ["channel = 'A'"], [{"column": "channel", "value": "A"}])
    for filters in forms:
        assert profiling.columns_to_discover({"filters": filters}) == ["event_type", "channel"]
    assert profiling.columns_to_discover({}) == ["event_type"]


def test_enum_conformance(spark):
    df = spark.createDataFrame([("A",), ("X",), ("X",)], "channel string")
    got = rows(profiling.enum_conformance(df, {"channel": ["A", "B"]}))
    assert got == [("channel", "B", "missing", 0), ("channel", "X", "unexpected", 2)]


def test_rules(bank):
    got = dict(rows(profiling.rule_violations(bank, profiling.event_rules(), unique="event_id")))
    assert set(got.values()) == {0}
    doubled = dict(rows(profiling.rule_violations(bank.union(bank), profiling.event_rules(), "event_id")))
    assert doubled["unique_event_id"] == bank.count()


def test_balance_is_carried_across_buckets(spark):
    steps = [(1, 1, 10, 10), (1, 2, 5, 15), (1, 3, -5, 10), (1, 4, 1, 12), (2, 1, 7, 7), (2, 5, 1, 8)]
    df = spark.createDataFrame(steps, "a int, t int, amount int, balance int")
    for width in (1, 2, 100):
        bucket = F.floor(F.col("t") / width)
        got = profiling.balance_continuity(df, "a", ["t"], "amount", "balance", bucket)
        assert rows(got) == [(6, 4, 1)]


def test_reconcile_and_percentages(spark, bank):
    assert quality.reconcile(bank, ["channel"], "event_amount").first().reconciles
    df = spark.createDataFrame([(-0.1,), (50.0,), (100.0,), (100.1,)], "pct double")
    assert rows(quality.percentages_in_range(df, ["pct"])) == [("pct", 2)]


# --- order statistics -----------------------------------------------------------------------------------


def test_quantiles_equal_the_definition_for_any_group(spark):
    rng = np.random.default_rng(4)
    values = {
        "hot": np.round(rng.lognormal(3, 4, 4000), 2), "one": np.array([7.0]), "same": np.full(50, -2.5),
        "two": np.array([1.0, 2.0]), "wide": np.array([-1.7e308, -1e-300, 0.0, 5e-324, 1.7e308]), None: rng.standard_normal(77),
    }
    data = [(g, float(v)) for g, vs in values.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None), ("two", float("inf"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {r.g: r.quantiles for r in ranks.quantiles(df, F.col("v"), ["g"], shares).collect()}
    assert got.keys() == values.keys()
    for g, vs in values.items():
        at = np.sort(vs)
        for share, q in zip(shares, got[g], strict=True):
            place = share * (len(at) - 1)
            low, part = int(np.floor(place)), place - np.floor(place)
            expected = (1 - part) * at[low] + part * at[int(np.ceil(place))]
            assert q == pytest.approx(expected, rel=1e-12)


def test_quantiles_without_groups_and_without_rows(spark):
    df = spark.range(1, 102)
    assert ranks.quantiles(df, F.col("id"), [], (0.25, 0.5)).first().quantiles == [26.0, 51.0]
    assert rows(ranks.quantiles(df.limit(0), F.col("id"), [], (0.5,))) == []


def test_outliers_find_rows_of_a_null_group(spark):
    data = [(None, float(i)) for i in range(20)] + [(None, 500.0), ("a", 1.0), ("a", float("nan"))]
    found = quality.outliers(spark.createDataFrame(data, "g string, v double"), "v", ["g"])
    assert {str(r.v) for r in found.collect()} == {"500.0", "nan"}


def test_outliers_hold_no_percentile(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = quality.outliers(df, "id", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()
