import pytest
from pyspark.sql import functions as F

from quorumlens.functions import scoring
from quorumlens.operators import evaluation
from quorumlens.sources import sessions
from tests.conftest import rows

SPANS = "trace_id int, span_id int, parent_id int, name string"


def test_span_paths(spark):
    tree = [(1, 1, None, "a"), (1, 2, 1, "b"), (1, 3, 2, "c"), (1, 4, 3, "d"), (1, 5, 4, "e"), (1, 6, 5, "f")]
    other = [(2, 1, None, "x"), (2, 2, 9, "orphan"), (2, 3, 2, "child")]
    got = {(r.trace_id, r.span_id): (r.path, r.depth) for r in
           evaluation.span_paths(spark.createDataFrame(tree + other, SPANS)).collect()}
    assert got[(1, 6)] == ("a/b/c/d/e/f", 5) and got[(1, 2)] == ("a/b", 1)
    assert got[(2, 1)] == ("x", 0) and got[(2, 2)] == ("orphan", 0) and got[(2, 3)] == ("orphan/child", 1)


def test_span_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        evaluation.span_paths(spark.createDataFrame([(1, 1, 2, "a"), (1, 2, 1, "b")], SPANS))


def test_unfinished_span_has_no_duration(spark):
    df = spark.createDataFrame([(5, 9), (5, None)], "start_ms int, end_ms int")
    assert [r.duration_ms for r in evaluation.span_durations(df).collect()] == [4, None]


TRACES = "session_id string, agent_name string, action string, duration_ms int, tokens_used int, error string"


@pytest.fixture(scope="module")
def traces(spark):
    data = [
        ("s1", "definition_agent", "started", None, 0, None),
        ("s1", "definition_agent", "completed", 10, 5, None),
        ("s1", "sql_agent", "failed", 30, 7, "boom"),
        ("s1", "sql_agent", "failed", 30, 7, "boom"),
        ("s2", "definition_agent", "completed", 20, 5, None),
        ("s2", "sql_agent", "completed", 20, 5, None),
        ("s2", "data_quality_agent", "completed", 1, 5, None),
        ("s2", "explanation_agent", "completed", 1, 5, None),
    ]
    return spark.createDataFrame(data, TRACES)


def test_stages(traces):
    status = {(r[0], r[1]): r[2] for r in evaluation.stage_status(traces).collect()}
    assert status[("s1", "definition_agent")] == "completed"
    assert status[("s1", "sql_agent")] == "started"
    assert status[("s1", "explanation_agent")] == "not_run"
    assert rows(evaluation.stage_funnel(traces)) == [("end", 1), ("sql_agent", 1)]
    logs = traces.select("session_id").distinct()
    assert rows(evaluation.sessions_with_stage(logs, traces, "sql_agent")) == [("s2",)]


def test_rollup_and_latency(traces):
    got = {r.session_id: r for r in evaluation.session_rollup(traces).collect()}
    assert (got["s1"].total_tokens, got["s1"].total_duration_ms, got["s1"].distinct_errors) == (19, 70, 1)
    assert rows(evaluation.session_errors(traces)) == [("s1", "sql_agent: boom")]
    latency = {r.metric: (r.runs, r.average_ms) for r in evaluation.agent_latency(traces).collect()}
    assert latency["latency_definition_agent"] == (2, 15.0)
    assert latency["latency_total"][0] == 7


def test_sessions_round_trip(spark, tmp_path):
    day = "timestamp'2024-05-06 07:08:09'"
    df = spark.sql(
        f"""SELECT 's1' AS session_id, 'q' AS question, {day} AS timestamp,
          array(named_struct('agent_name', 'a', 'action', 'failed', 'timestamp', {day}, 'duration_ms', 1.5D,
            'tokens_used', 3, 'input_summary', NULL, 'output_summary', NULL, 'error', 'x',
            'details', map('k', 'v'))) AS traces, array('a: x', 'late') AS errors"""
    )
    path = str(tmp_path / "sessions")
    sessions.write(df, path)
    back = sessions.read(spark, path)
    assert str(back.first().date) == "2024-05-06"
    assert rows(sessions.all_errors(back).select(F.array_join("errors", "|"))) == [("a: x|late",)]
    flat = sessions.traces(back).first()
    assert (flat.position, flat.agent_name, flat.details) == (0, "a", {"k": "v"})


def test_session_lines_that_are_no_documents(spark, tmp_path):
    day = tmp_path / "date=2024-05-06"
    day.mkdir()
    lines = ['{"session_id": "a", "errors": ["e"]}', '{"session_id": "b", "traces": [{', '["no object"]', '{"session_id": "c", "timestamp": "then"}']
    (day / "x.json").write_text("\n".join(lines))
    good, rejected = sessions.read_checked(spark, str(tmp_path))
    assert rows(good.select("session_id")) == [("a",)] and good.count() == 1
    assert sorted(r.text for r in rejected.collect()) == sorted(lines[1:]) and rejected.count() == 3


def test_errors_of_all_documents_of_a_session(spark):
    trace = "named_struct('agent_name', 'a', 'error', e)"
    df = spark.sql(
        f"""SELECT s AS session_id, timestamp'2024-01-01' AS timestamp, transform(t, e -> {trace}) AS traces, x AS errors
            FROM VALUES ('s', array('1', NULL), array('late')), ('s', array('1', '2'), NULL), ('t', NULL, array()) AS v(s, t, x)"""
    )
    assert rows(sessions.errors_by_session(df).select("session_id", "n_documents", F.array_join("errors", "|"))) == [
        ("s", 2, "a: 1|a: 2|late"), ("t", 1, ""),
    ]


# --- scores -------------------------------------------------------------------------------------------

BLANK = {
    "sql_query": None, "sql_explanation": None, "result_present": None, "result_success": None,
    "result_error": None, "result_has_columns": None, "row_count": None, "quality_status": None,
    "explanation_summary": None, "insight_count": None, "final_response": None, "error_count": None,
}
TYPES = (
    "sql_query string, sql_explanation string, result_present boolean, result_success boolean, "
    "result_error string, result_has_columns boolean, row_count int, quality_status string, "
    "explanation_summary string, insight_count int, final_response string, error_count int"
)
LONG = "a summary longer than twenty"

CASES = [
    ({}, (0, 0, 0, 50, 0, 100), "low"),
    (
        {"sql_query": "select 1", "result_present": True, "result_success": True, "row_count": 2,
         "quality_status": "PASS", "explanation_summary": LONG, "insight_count": 1, "error_count": 0},
        (100, 100, 100, 100, 100, 100), "high",
    ),
    (
        {"sql_query": "SELECT COUNT(x) HAVING 1", "result_present": True, "row_count": 0,
         "result_has_columns": True, "quality_status": "warning", "explanation_summary": LONG, "error_count": 1},
        (100, 100, 50, 75, 75, 50), "medium",
    ),
    ({"sql_query": "x", "result_present": True, "result_error": "e", "error_count": 2}, (50, 0, 0, 50, 0, 25), "low"),
    ({"sql_query": "SELECT", "sql_explanation": "Invalid", "result_present": True, "error_count": 3},
     (50, 50, 0, 50, 0, 0), "low"),
    ({"final_response": "x" * 51}, (0, 0, 0, 50, 75, 100), "low"),
    ({"final_response": "could not " + "x" * 50, "quality_status": "fail"}, (0, 0, 0, 25, 25, 100), "low"),
    ({"explanation_summary": "short"}, (0, 0, 0, 50, 50, 100), "low"),
]


def test_self_evaluation(spark):
    data = [tuple({**BLANK, **c}.values()) + (i,) for i, (c, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(data, TYPES + ", i int")
    got = evaluation.self_eval(df).orderBy("i").collect()
    for row, (_, scores, level) in zip(got, CASES):
        assert tuple(row[c] for c in scoring.COMPONENTS) == scores
        assert row.confidence == level
    assert float(got[1].overall) == 100 and got[1].issues == [] and got[1].stored_self_score == 100
    assert "privacy filtering" in got[2].issues[0]
    mean = (100 + 100 + 50 + 75 + 75 + 50 + float(got[2].overall)) / 7
    assert got[2].stored_self_score == pytest.approx(mean, abs=0.01)


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (90.0, 89.9, 70.0, 50.0, 30.0, 29.9)], "s double")
    assert [r[0] for r in df.select(scoring.band(F.col("s"))).collect()] == [5, 4, 4, 3, 2, 1]


def test_suite(spark):
    results = spark.createDataFrame(
        [(1, ["a", "b"], "DIGITAL and BRANCH", False), (2, ["a"], "DIGITAL", False), (3, [], "no", True), (4, ["a"], "x", True)],
        "case_id int, agents array<string>, response string, refused boolean",
    )
    expected = spark.createDataFrame(
        [(1, ["a"], ["DIGITAL", "BRANCH"], False), (2, ["a", "b"], ["DIGITAL"], False), (3, [], [], True), (4, ["a"], ["x"], False)],
        "case_id int, expected_agents array<string>, expected_contains array<string>, expected_out_of_scope boolean",
    )
    judged = evaluation.judge(results, expected)
    assert {r.case_id: r.passed for r in judged.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert [float(v) for v in evaluation.pass_rate(judged).first()] == [4, 2, 2, 50.0]
    some = evaluation.judge(results.where("case_id = 1"), expected)
    assert {r.case_id: r.passed for r in some.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_demo_verdicts(spark):
    cases = [
        (("boom", True, False, "x", "high"), (False, "Error: boom")),
        ((None, False, True, "x", None), (True, "Correctly refused (privacy/safety)")),
        ((None, True, True, "Sorry", None), (True, "Query modified/refused for safety")),
        ((None, True, True, "fine", None), (False, "Should have refused but executed")),
        ((None, False, False, "fine", "high"), (False, "Incorrectly refused valid query")),
        ((None, True, False, "fine", "medium"), (True, "Executed successfully (medium confidence)")),
        ((None, True, False, "fine", None), (False, "Low confidence: low")),
    ]
    df = spark.createDataFrame(
        [(i, *c[0]) for i, c in enumerate(cases)],
        "i int, error string, is_in_scope boolean, should_refuse boolean, final_response string, confidence string",
    )
    got = df.withColumn("v", scoring.demo_verdict()).orderBy("i").collect()
    assert [tuple(r.v) for r in got] == [c[1] for c in cases]
