import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumlens import GovernancePolicy, PolicyViolation
from quorumlens.functions import scoring, textguard
from quorumlens.operators import triage
from quorumlens.sources import events


def _column(spark, values):
    indexed = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(indexed, "i int, t string").coalesce(1)


def _ordered(df):
    return df.orderBy("i").collect()


def test_scope(spark):
    cases = [
        ("What's the total fee by channel?", "in_scope", 0.9),
        ("balance", "in_scope", 0.7),
        ("who are you", "unclear", 0.5),
        ("Hello", "out_of_scope", 0.6),
        ("Tell me a joke about the weather and my balance", "out_of_scope", 0.9),
        ("baby", "out_of_scope", 0.6),
        (" what", "out_of_scope", 0.6),
    ]
    got = _ordered(triage.scope(_column(spark, [c[0] for c in cases]), "t"))
    assert [(r.scope.status, r.scope.confidence) for r in got] == [c[1:] for c in cases]
    assert "'weather'" in got[4].scope.reason  # list order, not text order
    assert [r.scope.allowed for r in got] == [True, True, True, False, False, False, False]


def test_intent_precedence(spark):
    cases = {
        "compare the trend": "trend",
        "branch vs digital": "comparison",
        "totals per client": "drill_down",
        "show all": "data_exploration",
        "baby steps": "drill_down",
        "deposits": "metric_query",
    }
    df = _column(spark, list(cases)).withColumn("x", textguard.intent(F.col("t")))
    assert [r.x for r in _ordered(df)] == list(cases.values())


SQL_CASES = [
    ("SELECT channel FROM events LIMIT 10", "valid"),
    ("SELECT channel FROM events", "warning"),
    ("SELECT channel\nFROM events\nLIMIT 3", "warning"),
    ("DELETE FROM events", "invalid"),
    ("SELECT 1; DROP TABLE x", "invalid"),
    ("SELECT a FROM events WHERE 1=1 OR 1=1 LIMIT 1", "invalid"),
    ("SELECT a FROM events WHERE x = '' OR 'a' LIMIT 1", "invalid"),
    ("SELECT odd_column FROM events LIMIT 1", "warning"),
    ("", "invalid"),
    ("   \n", "invalid"),
    ("SELECT a /* b */ FROM events LIMIT 1", "invalid"),
    ("SELECT a /* b\n c */ FROM events LIMIT 1", "warning"),
    ("SELECT a FROM events LIMIT 1 --", "invalid"),
    ("SELECT a FROM x UNION  ALL  SELECT a FROM y LIMIT 1", "invalid"),
    ("SELECT a FROM x UNION SELECT a FROM y LIMIT 1", "valid"),
    ("SELECT a FROM x WHERE b = 'grant' LIMIT 1", "invalid"),
    ("WITH q AS (SELECT 1) SELECT 2 LIMIT 1", "valid"),
    ("MERGE INTO x", "invalid"),
    ("select updated FROM events LIMIT 1", "valid"),
]


def test_sql_verdicts(spark):
    got = _ordered(triage.sql(_column(spark, [c[0] for c in SQL_CASES]), "t"))
    assert [r.verdict.status for r in got] == [c[1] for c in SQL_CASES]
    assert got[0].warnings == []
    assert got[7].warnings == ["Possible invalid column reference: 'odd_column'"]
    assert got[17].verdict.reason == "Query must start with SELECT or WITH. Got: MERGE INTO X..."


def test_strict_blocks_merge(spark):
    text = "SELECT a FROM x WHERE note = 'merge' LIMIT 1"
    loose, strict = (
        triage.sql(_column(spark, [text]), "t", strict=s).first().verdict.status for s in (False, True)
    )
    assert (loose, strict) == ("valid", "invalid")


def test_sanitize_and_limit(spark):
    df = _column(spark, ["SELECT a -- x\nFROM  t /* y\nz */ ;", "SELECT credit_limit FROM t"])
    got = _ordered(
        df.withColumn("clean", textguard.sanitize(F.col("t"))).withColumn(
            "limited", textguard.add_limit(F.col("t"), 7)
        )
    )
    assert got[0].clean == "SELECT a FROM t ;"
    assert got[0].limited.endswith(" LIMIT 7") and ";" not in got[0].limited
    assert got[1].limited == "SELECT credit_limit FROM t"


PII_CASES = [
    ("id 123-45-6789 and a@b.org", False, "Social Security"),
    ("card 1234567890123456", False, "Credit card"),
    ("card x1234567890123456", True, ""),
    ("card 12345678901234567", True, ""),
    ("mail a.b+c@d-e.co", False, "Email"),
    ("the ToKen is", False, "token"),
    (None, True, "None"),
    ("nothing to see", True, "safe"),
]


def test_pii(spark):
    got = _ordered(triage.pii(_column(spark, [c[0] for c in PII_CASES]), "t"))
    for row, (_, safe, word) in zip(got, PII_CASES):
        assert row.pii.safe == safe and word in row.pii.reason


def test_redaction_replaces_every_match(spark):
    df = _column(spark, ["123-45-6789 x 987-65-4321, 1111222233334444 a@b.cd e@f.gh", None])
    got = _ordered(df.withColumn("r", textguard.redact(F.col("t"))))
    assert got[0].r == "[SSN REDACTED] x [SSN REDACTED], [CARD REDACTED] [EMAIL REDACTED] [EMAIL REDACTED]"
    assert got[1].r is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab1-@. 9\n", max_size=60), min_size=1, max_size=20))
def test_redacted_text_is_clean(spark, texts):
    df = _column(spark, texts).withColumn("t", textguard.redact(F.col("t")))
    reasons = [r.pii.reason for r in triage.pii(df, "t").collect()]
    assert not any("PII" in reason for reason in reasons)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("SELECT LIMIT;-/*\n'ORa_b", max_size=40), min_size=1, max_size=20))
def test_sanitize_leaves_single_blanks(spark, texts):
    df = _column(spark, texts).withColumn("c", textguard.sanitize(F.col("t")))
    assert not any(re.search(r"\s\s|^\s|\s$", r.c) for r in df.collect())


def test_truncate(spark):
    df = _column(spark, ["é" * 5, "é" * 6])
    assert [r.x for r in _ordered(df.withColumn("x", textguard.truncate(F.col("t"), 5)))] == [
        "é" * 5, "é" * 5 + "...",
    ]


def test_json_from_text(spark):
    cases = ['```json\n{"a": 1}\n``` end', '``` {"a": 2} ```', '{"a": 3}', "no", "```json\n{bad}\n```", '```json\n{"a": 4}\n']
    df = _column(spark, cases).withColumn("v", textguard.json_from_text(F.col("t")))
    got = _ordered(df.select("i", F.try_variant_get("v", "$.a", "int").alias("a")))
    assert [r.a for r in got] == [1, 2, 3, None, None, 4]


def test_feedback_words(spark):
    words = ["👍", " Great ", "5", "6", "n", "not great", "alright", "meh", "", "could be better"]
    df = _column(spark, words).withColumn("s", scoring.feedback_score(F.col("t")))
    assert [r.s for r in _ordered(df)] == [5, 5, 5, None, 1, 2, 4, 3, None, 2]


# --- guarded SQL --------------------------------------------------------------------------------------


def test_query_over_both_names(spark, bank):
    events.register(bank)
    for name in events.VIEW_NAMES:
        got = events.query_pandas(spark, f"SELECT COUNT(*) AS n FROM {name} LIMIT 1")
        assert got.n[0] == bank.count()


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE events",
        "SELECT account_id FROM events LIMIT 1",
        "SELECT 1 AS Customer_Id",
        "SELECT 1 UNION ALL SELECT 2",
        "SELECT channel FROM events LIMIT 5",
        "SELECT channel FROM events UNION SELECT x FROM (SELECT event_name AS x FROM events) LIMIT 5 --",
        "WITH t AS (SELECT COUNT(*) AS n FROM events) SELECT channel, n FROM events JOIN t ON n > 1",
    ],
)
def test_query_refuses(spark, bank, sql):
    events.register(bank)
    with pytest.raises(PolicyViolation):
        events.query(spark, sql)


def test_row_level_results_can_be_allowed(spark, bank):
    events.register(bank)
    sql = "SELECT channel FROM events LIMIT 5"
    assert events.query(spark, sql, GovernancePolicy(require_aggregation=False)).count() == 5
    assert events.query(spark, "SELECT DISTINCT channel FROM events LIMIT 5").count() == 3


def test_query_raises_analysis_errors(spark, bank):
    events.register(bank)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        events.query(spark, "SELECT nothing FROM events LIMIT 1")
