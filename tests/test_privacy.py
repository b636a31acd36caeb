import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quorumlens import GovernancePolicy, PolicyViolation
from quorumlens.operators import patterns, privacy
from quorumlens.plans import definition
from quorumlens.plans.definition import Definition, Filter, Measure, TimeRange
from quorumlens.sources import events as event_source
from tests.conftest import rows


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(4)], "g string, e int")
    kept = privacy.k_anon(df, ["g"], [F.count("*").alias("n")], "e", 5)
    assert rows(kept) == [("a", 5)]


def test_repeated_entities_count_once(spark):
    df = spark.createDataFrame([("a", 1)] * 50, "g string, e int")
    assert rows(privacy.k_anon(df, ["g"], [F.count("*").alias("n")], "e", 2)) == []


def test_report_covers_all_rows(bank):
    report = privacy.k_anon_report(bank, [F.date_format("event_date", "yyyy-MM")], "account_id", 5).first()
    assert report.kept_groups == 2 and report.suppressed_groups == 1
    assert report.kept_rows + report.suppressed_rows == bank.count()


def test_empty_table_gives_empty_report(bank):
    report = privacy.k_anon_report(bank.limit(0), ["channel"], "account_id", 5).first()
    assert tuple(report) == (0, 0, 0, 0)


MEASURES = {"total": ("sum", "event_amount"), "n": ("count", "event_id")}


def _rolled(bank, k):
    months = bank.withColumn("month", F.date_format("event_date", "yyyy-MM"))
    return privacy.k_anon_rollup(months, ["month", "product_type"], MEASURES, "account_id", k)


def test_rollup_shows_parts_when_all_are_large_enough(bank):
    shown = rows(_rolled(bank, 1).select("level", "month", "product_type"))
    assert {r[0] for r in shown} == {2} and len(shown) == 6


def test_rollup_falls_back_to_the_parent(bank):
    # February has 2 + 1 accounts: its products are not shown at k = 2, the month is
    shown = rows(_rolled(bank, 2).select("level", "month", "product_type"))
    assert (1, "2024-02", None) in shown
    assert not any(r[0] == 2 and r[1] == "2024-02" for r in shown)


def test_rollup_hides_siblings_of_a_hidden_group(bank):
    # February fails at k = 5, so no month may stand next to the total
    assert rows(_rolled(bank, 5).select("level", "month")) == [(0, None)]


def test_rollup_shows_nothing_when_the_total_fails(bank):
    assert rows(_rolled(bank, 9)) == []


def test_rollup_parts_add_up(bank):
    for k in (1, 2, 5):
        total = _rolled(bank, k).agg(F.sum("total"), F.sum("n")).first()
        assert tuple(total) == tuple(bank.agg(F.sum("event_amount"), F.count("*")).first())


def test_rollup_keeps_null_values_apart_from_totals(spark):
    df = spark.createDataFrame(
        [(None, i, i) for i in range(3)] + [("x", i, i) for i in range(3)], "d string, e int, v int"
    )
    shown = privacy.k_anon_rollup(df, ["d"], {"t": ("sum", "v")}, "e", 3)
    assert {tuple(r) for r in shown.collect()} == {(1, "x", 3, 3), (1, None, 3, 3)}
    both = privacy.k_anon_rollup(df, ["d"], {"t": ("sum", "v")}, "e", 4)
    assert rows(both) == []  # the same three entities are behind both values


def test_audit_lists_small_cells(spark):
    result = spark.createDataFrame(
        [("DIGITAL", 10.0, 4), ("BRANCH", 20.0, 5), ("BATCH", None, -1)],
        "channel string, total double, unique_customers bigint",
    )
    found = rows(privacy.audit(result, 5))
    assert [(r[0], r[1]) for r in found] == [("unique_customers", -1.0), ("unique_customers", 4.0)]
    assert '"channel":"DIGITAL"' in found[1][2] and '"total":null' in found[0][2]


def test_count_like_names_follow_the_written_rule():
    assert privacy.is_count_like("discount") and privacy.is_count_like("account_type")
    assert privacy.is_count_like("Unique_x") and not privacy.is_count_like("total")


def test_audit_without_count_columns(spark):
    assert rows(privacy.audit(spark.createDataFrame([("a", 1)], "channel string, total int"), 5)) == []


@pytest.mark.parametrize("name", ["customer_id", "Account_ID"])
def test_identifiers_are_refused(spark, name):
    with pytest.raises(PolicyViolation):
        GovernancePolicy().check_columns(spark.createDataFrame([(1,)], f"{name} int"))


def test_distribution_hides_small_buckets(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(12)], "e int, v int")
    shown = rows(privacy.entity_distribution(df, "e", "v", [20, 100], 3))
    assert [(r[0], r[1]) for r in shown] == [(1, 8)]


# --- definitions --------------------------------------------------------------------------------------


def test_definition_without_dimensions(bank):
    spec = {"metric": {"function": "COUNT", "column": "*", "alias": "n"}, "dimensions": [], "filters": []}
    assert rows(definition.run(bank, definition.normalise(spec))) == [(bank.count(),)]


def test_second_form_of_a_definition(bank):
    spec = {
        "metrics": ["net_flow", "COUNT(*)"],
        "dimensions": ["channel"],
        "filters": {"event_amount": "> 0", "event_type": ["money_movement"]},
        "time_grain": "month",
    }
    parsed = definition.normalise(spec)
    assert parsed.dimensions == ("month", "channel")
    assert parsed.filters == (
        Filter("event_amount", ">", "0"),
        Filter("event_type", "IN", ("money_movement",)),
    )
    assert rows(definition.run(bank, parsed)) == [
        ("2024-01", "DIGITAL", Decimal("804.00"), 8),
        ("2024-03", "DIGITAL", Decimal("804.00"), 8),
    ]


def test_definition_time_range_is_inclusive(bank):
    span = TimeRange(dt.date(2024, 1, 3), dt.date(2024, 1, 17))
    made = Definition((Measure("COUNT", alias="n"),), time_range=span)
    assert rows(definition.run(bank, made)) == [(16,)]


def test_definition_refuses_identifiers(bank):
    with pytest.raises(PolicyViolation):
        definition.run(bank, Definition((Measure("COUNT"),), ("customer_id",)))
    with pytest.raises(PolicyViolation):
        definition.run(bank, Definition((Measure("MIN", "account_id"),)))
    counted = Definition((Measure("COUNT_DISTINCT", "account_id", "accounts"),))
    assert rows(definition.run(bank, counted)) == [(8,)]


def test_definition_applies_limit_even_when_a_column_contains_the_word(bank):
    renamed = bank.withColumnRenamed("channel", "credit_limit")
    made = Definition((Measure("COUNT"),), ("credit_limit", "event_date"))
    whole = definition.run(renamed, made, GovernancePolicy(k=1))
    assert whole.count() > 2 and "truncated" not in whole.columns
    part = definition.run(renamed, made, GovernancePolicy(k=1), limit=2).collect()
    assert [(r.truncated, r.total_rows) for r in part] == [(True, whole.count())] * 2


@pytest.mark.parametrize(
    "spec",
    [
        {"filters": {"channel": "NOT IN ('A')"}},
        {"filters": ["channel ~ 'A'"]},
        {"filters": [{"column": "channel", "operator": "~", "value": 1}]},
        {"time_grain": "fortnight"},
        {"time_range": {"period": "sometimes"}},
        {"metrics": ["Happiness"]},
    ],
)
def test_unknown_forms_of_a_definition_are_errors(bank, spec):
    with pytest.raises(ValueError):
        definition.run(bank, definition.normalise({"metrics": ["COUNT(*)"]} | spec))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT account_id AS a, COUNT(*) AS n FROM events GROUP BY account_id",
        "SELECT MIN(customer_id) AS c FROM events",
        "SELECT DISTINCT event_id, event_amount FROM events LIMIT 10",
        "WITH t AS (SELECT account_id AS a FROM events) SELECT a AS b, COUNT(*) AS n FROM t GROUP BY a",
        "SELECT channel, MAX(x) AS m FROM (SELECT channel, concat(account_id, 'x') AS x FROM events) GROUP BY channel",
        "SELECT channel AS x, COUNT(*) AS n FROM events GROUP BY channel UNION SELECT account_id, COUNT(*) FROM events GROUP BY 1",
        "SELECT COUNT(*) AS n, (SELECT MAX(account_id) FROM events) AS m FROM events",
        "SELECT date_format(event_ts, 'yyyy-MM-dd HH:mm:ss') AS t, COUNT(*) AS n FROM events GROUP BY 1",
        "SELECT date_trunc('minute', event_ts) AS t, COUNT(*) AS n FROM events GROUP BY 1",
        "SELECT event_date, MAX(event_id) AS e, SUM(event_amount) AS s FROM events GROUP BY event_date",
        "SELECT histogram_numeric(event_amount, 1000) AS h FROM events",
        "SELECT collect_list(event_amount) AS h FROM events",
        "SELECT channel, max_by(event_amount, event_ts) AS a FROM events GROUP BY channel",
        "SELECT SUM(event_amount) AS s FROM events WHERE account_id = 'A1'",
        "SELECT SUM(event_amount) AS s FROM events WHERE channel = 'DIGITAL' AND NOT (customer_id <> 'C1')",
        "SELECT SUM(event_amount) AS s FROM (SELECT account_id AS a, event_amount FROM events) WHERE a LIKE 'A1%'",
        "SELECT SUM(event_amount) FILTER (WHERE account_id = 'A1') AS s FROM events",
        "SELECT COUNT(CASE WHEN account_id = 'A1' THEN 1 END) AS n FROM events",
        "SELECT channel, COUNT(*) AS n FROM events GROUP BY channel HAVING MAX(account_id) = 'A1'",
        "SELECT SUM(e.event_amount) AS s FROM events e JOIN (VALUES ('A1')) v(x) ON e.account_id = v.x",
        "SELECT SUM(event_amount) AS s FROM events WHERE account_id IN ('A1', 'A2')",
        "WITH t AS (SELECT * FROM events WHERE account_id = 'A1') SELECT channel, COUNT(*) AS n FROM t GROUP BY channel",
        "SELECT COUNT(*) AS n, (SELECT SUM(event_amount) FROM events WHERE channel = 'BATCH') AS m FROM events",
    ],
)
def test_identifiers_do_not_leave_under_other_names(spark, bank, sql):
    event_source.register(bank)
    with pytest.raises(PolicyViolation):
        event_source.query(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT channel, COUNT(DISTINCT account_id) AS n, SUM(event_amount) AS s FROM events GROUP BY channel",
        "SELECT date_format(event_ts, 'yyyy-MM') AS month, COUNT(*) AS n FROM events GROUP BY 1",
        "WITH t AS (SELECT channel, COUNT(DISTINCT account_id) AS n FROM events GROUP BY channel) SELECT * FROM t WHERE n > 1",
        "SELECT MIN(event_date) AS first, MAX(event_date) AS last, COUNT(DISTINCT CASE WHEN event_amount > 0 THEN account_id END) AS n FROM events",
        "SELECT a.channel, COUNT(*) AS n FROM events a JOIN (SELECT DISTINCT account_id AS x FROM events) b ON a.account_id = b.x GROUP BY a.channel",
        "SELECT channel, COUNT(*) AS n FROM events WHERE account_id IS NOT NULL GROUP BY channel",
        "SELECT channel, COUNT(*) AS n FROM events WHERE account_id IN (SELECT account_id FROM events WHERE event_amount > 0) GROUP BY channel",
        "SELECT channel, SUM(event_amount) / (SELECT SUM(event_amount) FROM events) AS share FROM events GROUP BY channel",
        "SELECT AVG(n) AS average FROM (SELECT account_id, COUNT(*) AS n FROM events GROUP BY account_id)",
        "SELECT date_trunc('month', event_ts) AS m, COUNT(*) AS n FROM events GROUP BY 1",
    ],
)
def test_aggregates_are_answered_in_full(spark, bank, sql):
    event_source.register(bank)
    assert event_source.query(spark, sql).count() > 0


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT channel, COUNT(*) AS n FROM events GROUP BY channel", [("DIGITAL", 38)]),
        ("SELECT month(event_date) AS m, COUNT(*) AS n FROM events GROUP BY 1", [(1, 16), (3, 18)]),
        ("WITH t AS (SELECT channel FROM events) SELECT channel, COUNT(*) AS n FROM t GROUP BY channel", [("DIGITAL", 38)]),
        ("SELECT COUNT(*) AS n FROM events WHERE channel = 'BATCH'", []),
        ("SELECT SUM(n) AS n FROM (SELECT channel, COUNT(*) AS n FROM events GROUP BY channel)", [(38,)]),
        ("SELECT channel, COUNT(DISTINCT customer_id) AS n FROM events GROUP BY channel HAVING COUNT(*) > 0", [("DIGITAL", 4)]),
        ("SELECT 'all' AS k, COUNT(*) AS n FROM events UNION SELECT channel, COUNT(*) FROM events GROUP BY channel", [("DIGITAL", 38), ("all", 40)]),
        ("SELECT MAX(n) AS n FROM (SELECT account_id, COUNT(*) AS n FROM events GROUP BY account_id)", [(8,)]),
        ("SELECT c, COUNT(*) AS n FROM (SELECT channel AS c, COUNT(*) AS x FROM events GROUP BY account_id, channel) GROUP BY c", [("DIGITAL", 8)]),
    ],
)
def test_groups_of_few_entities_are_removed_from_any_text(spark, bank, sql, expected):
    event_source.register(bank)
    assert rows(event_source.query(spark, sql)) == expected


def test_groups_are_whole_without_an_entity(spark, bank):
    event_source.register(bank)
    policy = GovernancePolicy(entity=None)
    assert event_source.query(spark, "SELECT channel, COUNT(*) AS n FROM events GROUP BY channel", policy).count() == 3


def test_a_grouping_that_cannot_be_counted_is_refused(spark, bank):
    event_source.register(bank)
    twice = "SELECT channel, COUNT(*) AS n FROM (SELECT channel FROM events UNION SELECT event_name FROM events) GROUP BY channel"
    with pytest.raises(PolicyViolation):
        event_source.query(spark, twice)


def test_local_result_says_what_was_cut(spark, bank):
    event_source.register(bank)
    frame = event_source.query_pandas(spark, "SELECT channel, event_date, COUNT(*) AS n FROM events GROUP BY 1, 2 ORDER BY 2, 1", GovernancePolicy(max_rows=3))
    assert len(frame) == 3 and frame.attrs["truncated"] and frame.attrs["total_rows"] > 3


def test_values_are_never_read_as_sql(bank):
    made = Definition((Measure("COUNT", alias="n"),), filters=(Filter("channel", "=", "x' OR '1'='1"),))
    assert rows(definition.run(bank, made, GovernancePolicy(k=0))) == [(0,)]


# --- patterns -----------------------------------------------------------------------------------------


def test_monthly_net_flow_hides_small_months(bank):
    got = rows(patterns.monthly_net_flow(bank, policy=GovernancePolicy(k=3)))
    assert [r[:2] for r in got] == [
        ("2024-01", "CHEQUING"), ("2024-01", "SAVINGS"), ("2024-03", "CHEQUING"), ("2024-03", "SAVINGS"),
    ]
    assert got[0][2] == Decimal("241.00")


def test_relative_windows_count_from_the_newest_date(bank):
    assert patterns.recent(bank, 1).count() == bank.filter("event_date > '2024-02-29'").count()
    assert patterns.last_complete_month(bank).count() == bank.filter("month(event_date) = 3").count()
    cut = bank.filter("event_date < '2024-03-31'")
    assert patterns.last_complete_month(cut).count() == bank.filter("month(event_date) = 2").count()


def test_change_is_null_for_the_first_month_and_zero_base(spark, bank):
    got = rows(patterns.month_over_month(bank, ["product_type"]))
    assert got[0][3] is None and got[0][5] is None


def test_product_mix_counts_all_event_types(bank):
    assert sum(r.events for r in patterns.product_mix(bank).collect()) == bank.count()


def test_share_of_total_sums_to_hundred(bank):
    got = patterns.channel_share(bank).collect()
    assert sum(r.pct for r in got) == Decimal("100.00")


def test_preview_sorts_by_the_date_column_as_text(spark):
    df = spark.createDataFrame([(5, "2024-02"), (6, "2024-01")], "n int, month string")
    assert [r.month for r in patterns.preview(df).collect()] == ["2024-01", "2024-02"]
