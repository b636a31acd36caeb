import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quorumlens import session
from quorumlens.sources import catalog, events
from tests.conftest import rows

CSV = """event_id,event_ts,event_date,account_id,customer_id,product_type,event_type,event_name,channel,event_amount,currency,balance_after
E1,2024-01-02 09:00:00,2024-01-02,A1,C1,SAVINGS,money_movement,deposit,BRANCH,10.50,CAD,20.50
E2,2024-01-03 09:00:00,2024-01-03,A1,C1,SAVINGS,account_status,frozen,BRANCH,,CAD,20.50
"""

SCHEMA = {
    "table_name": "moves",
    "description": "money moves",
    "query_hints": {
        "default_time_grain": "week",
        "privacy": {"no_identifier_output": True, "k_anonymity_min_distinct_accounts": 7},
        "cost_controls": {"distinct_value_limit": 9, "result_row_limit": 50},
    },
    "columns": [
        {"name": "kind", "type": "STRING", "description": "what", "is_categorical": True, "enum": ["a", "b"],
         "value_discovery": {"enabled": True, "limit": 10}},
        {"name": "amount", "type": "NUMERIC", "description": "how much"},
    ],
    "enums": {"kind": {"a": "first", "b": "second"}, "detail": {"a": ["x", "y"]}, "plain": ["p", "q"]},
    "notes": ["careful", "very"],
}

KNOWLEDGE = {
    "glossary": {"products": {"Jar": "holds coins"}, "terms": {"Flow": "in minus out"}},
    "metrics": {"size": [{"name": "Total", "definition": "all", "sql": "SUM(amount)"}],
                "people": [{"name": "Heads", "definition": "who", "sql": "COUNT(DISTINCT c)"}]},
    "sql_patterns": {"daily": {"description": "per day", "sql": "SELECT 1"}},
    "business_rules": ["never negative"],
    "question_mapping": [{"question_pattern": "how big?", "key_filters": None, "aggregation": "SUM(amount)"}],
}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "e.csv").write_text(CSV)
    (tmp_path / "schema.json").write_text(json.dumps(SCHEMA, indent=1))
    (tmp_path / "knowledge.json").write_text(json.dumps(KNOWLEDGE, indent=1))
    return tmp_path


def test_csv(spark, files):
    df = events.read_csv(spark, str(files / "e.csv"))
    assert dict(df.dtypes)["event_amount"] == "decimal(18,2)"
    first, second = df.orderBy("event_id").collect()
    assert first.event_amount == Decimal("10.50") and second.event_amount is None
    assert spark.table("sample_events").count() == spark.table("events").count() == 2
    assert dict(events.read_csv(spark, str(files / "e.csv"), infer=True).dtypes)["event_amount"] == "double"
    events.register_file(spark, "by_file", str(files / "e.csv"))
    assert spark.table("by_file").columns[0] == "event_id"


def test_lines_that_are_no_events_are_rejected(spark, tmp_path):
    lines = CSV + "\nE3,2024-01-02\nE4" + ",x" * 20 + "\nE5,not a time,2024-01-02,A,C,S,m,d,B,1.0,CAD,2.0\nE6,2024-01-02 09:00:00,2024-01-02,A,C,S,m,d,B,much,CAD,2.0\n"
    (tmp_path / "e.csv").write_text(lines)
    good, rejected = events.read_csv_checked(spark, str(tmp_path / "e.csv"))
    assert [r.event_id for r in good.orderBy("event_id").collect()] == ["E1", "E2"] and good.count() == 2
    assert sorted(r.line[:2] for r in rejected.collect()) == ["E3", "E4", "E5", "E6"] and rejected.count() == 4
    assert spark.table("events").count() == 2 and good.select("channel").distinct().count() == 1


def test_parquet_round_trip(spark, files, bank):
    path = str(files / "events")
    bank.withColumn("month", F.date_format("event_date", "yyyy-MM")).write.partitionBy("month").parquet(path)
    df = events.read_parquet(spark, path).filter("month = '2024-02'").select("event_amount")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "ReadSchema: struct<event_amount" in plan


def test_schema_document(spark, files):
    doc = catalog.read_schema_document(spark, str(files / "schema.json"))
    assert [(r.name, r.is_categorical, r.discovery_limit) for r in catalog.columns(doc).collect()] == [
        ("kind", True, 10), ("amount", False, None),
    ]
    assert catalog.column_info(doc, "kind").first().allowed_values == ["a", "b"]
    assert rows(catalog.enum_values(doc, "kind")) == [("kind", "a", "first"), ("kind", "b", "second")]
    assert rows(catalog.enum_values(doc, "detail")) == [("detail", "a", "x, y")]
    assert rows(catalog.enum_values(doc, "plain")) == [("plain", "p", None), ("plain", "q", None)]
    assert rows(catalog.notes(doc)) == [(0, "careful"), (1, "very")]


def test_second_schema_layout(spark, tmp_path):
    old = {"table": "moves", "source": "m.csv", "description": "d",
           "columns": [{"name": "kind", "type": "STRING", "description": "what", "values": ["a"]}],
           "metrics": [{"name": "m", "description": "x", "sql": "COUNT(*)"}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    doc = catalog.read_schema_document(spark, str(tmp_path / "old.json"))
    assert catalog.columns(doc).first().allowed_values == ["a"]
    assert rows(catalog.schema_metrics(doc)) == [("m", "x", "COUNT(*)")]


def test_schema_chunks(spark, files):
    doc = catalog.read_schema_document(spark, str(files / "schema.json"))
    texts = [r.content for r in catalog.schema_chunks(doc).collect()]
    assert "Table: moves\nDescription: money moves" in texts
    assert (
        "Query Guidelines for moves:\n- Default time grain: week\n- Privacy: k-anonymity minimum 7 accounts\n"
        "- No identifiers in output: True\n- Result row limit: 50" in texts
    )
    assert "Column: kind\nType: STRING\nDescription: what\nCategorical: Yes\nPossible values: a, b" in texts
    assert "Column: amount\nType: NUMERIC\nDescription: how much" in texts
    assert "Enum Value: kind = 'a'\nMeaning: first" in texts
    assert "Enum: plain\nValues: p, q" in texts and "Schema Note: very" in texts
    assert [r.content for r in catalog.column_chunks(doc).collect()] == ["kind: what", "amount: how much"]


def test_knowledge_document(spark, files):
    doc = catalog.read_knowledge_document(spark, str(files / "knowledge.json"))
    assert rows(catalog.metrics(doc, "size")) == [("size", "Total", "all", "SUM(amount)")]
    assert catalog.metrics(doc).count() == 2 and rows(catalog.metrics(doc, "none")) == []
    assert rows(catalog.glossary(doc)) == [("product", "Jar", "holds coins"), ("term", "Flow", "in minus out")]
    assert rows(catalog.sql_patterns(doc)) == [("daily", "per day", "SELECT 1")]
    assert rows(catalog.business_rules(doc)) == [(0, "never negative")]
    assert rows(catalog.question_mapping(doc)) == [("how big?", None, "SUM(amount)")]
    asked = spark.createDataFrame([(" How big?",), ("else",)], "q string")
    assert rows(catalog.match_questions(asked, doc, "q")) == [
        (" How big?", None, "SUM(amount)"), ("else", None, None),
    ]
    chunks = {r.content: r.metadata for r in catalog.knowledge_chunks(doc).collect()}
    assert chunks["Product Term: Jar\nDefinition: holds coins"]["category"] == "product"
    assert "Business Term: Flow\nDefinition: in minus out" in chunks
    metric = "Metric: Total\nCategory: size\nDefinition: all\nSQL Pattern: SUM(amount)"
    assert chunks[metric] == {"type": "metric", "category": "size", "name": "Total"}
    assert "SQL Pattern: daily\nDescription: per day\nExample SQL: SELECT 1" in chunks
    assert chunks["Business Rule: never negative"]["index"] == "0"
    assert "Question Pattern: how big?\nKey Filters: None\nAggregation: SUM(amount)" in chunks


def test_sections_that_no_reader_knows(spark, tmp_path):
    document = KNOWLEDGE | {"owners": {"a": "x", "b": [1, 2]}, "tags": ["p", {"q": 1}], "version": 3, "empty": {}, "none": None}
    (tmp_path / "k.json").write_text(json.dumps(document, indent=1))
    found = catalog.sections(spark, str(tmp_path / "k.json"))
    assert {r.section for r in found.collect()} == document.keys()
    known = ["glossary", "metrics", "sql_patterns", "business_rules", "question_mapping"]
    other = catalog.unknown_sections(found, known)
    assert rows(other.filter("section <> 'none'")) == [
        ("owners", "a", "x"), ("owners", "b", "[1,2]"), ("tags", "0", "p"), ("tags", "1", '{"q":1}'), ("version", "version", "3"),
    ]
    chunks = {r.content: r.metadata for r in catalog.unknown_chunks(other).collect()}
    assert chunks["owners / a: x"] == {"type": "other", "section": "owners", "name": "a"}


def test_documents_a_line(spark, tmp_path):
    (tmp_path / "k.json").write_text("\n".join(json.dumps(KNOWLEDGE) for _ in range(3)))
    assert catalog.read_knowledge_document(spark, str(tmp_path / "k.json"), lines=True).count() == 3


def test_templates_are_ranked_by_coverage(spark):
    templates = spark.createDataFrame(
        [("How much money was deposited?",), ("How much money was withdrawn",), ("the fees",), ("the the",), ("??",), (None,)], "t string"
    )
    asked = ["how MUCH was deposited today", "fees, the fees!", "how much money", "nothing", None, "the"]
    questions = spark.createDataFrame([(i, q) for i, q in enumerate(asked)] + [(9, asked[0])], "n int, q string")
    got = {r.n: (r.t, r.n_shared, r.coverage) for r in catalog.match_templates(questions, templates, "q", "t").collect()}
    assert got == {
        0: ("How much money was deposited?", 4, 0.8), 9: ("How much money was deposited?", 4, 0.8), 1: ("the fees", 2, 1.0),
        2: ("How much money was deposited?", 3, 0.6), 3: (None, None, None), 4: (None, None, None), 5: ("the the", 1, 1.0),
    }


def test_describe(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "n int, t string")
    assert rows(catalog.describe(df)) == [(0, "n", "int"), (1, "t", "string")]
    assert rows(catalog.describe_with_samples(df, "n")) == [(0, "n", "int", "1 | 2"), (1, "t", "string", "x | None")]


class _Session:
    """The parts of a session that name the shared folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master


def test_shared_folder_follows_the_session(spark):
    assert session.scratch_path(_Session("yarn", "s3://b/c/"), "x").startswith("s3://b/c/quorumlens/x-")
    with pytest.raises(RuntimeError):
        session.shared_folder(_Session("yarn"))
    assert session.shared_folder(spark) == session.shared_folder(spark)
