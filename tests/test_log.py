import datetime as dt

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import evaluation
from quorumlens.sources import log_table
from quorumlens.sources.log_table import LogTable
from tests.conftest import rows

NARROW = "id string, user_score int, user_feedback string, v int"


def test_upsert_replaces_and_adds(spark):
    base = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, None, 1)], NARROW)
    changes = spark.createDataFrame([("b", 9, "n", 2), ("b", 8, "o", 1), ("c", 3, None, 1)], NARROW)
    got = rows(log_table.upsert(base, changes, "id", ["v"]))
    assert got == [("a", 1, "x", 1), ("b", 9, "n", 2), ("c", 3, None, 1)]


def test_update_writes_null_and_ignores_unknown(spark):
    base = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 1)], NARROW)
    changes = spark.createDataFrame([("a", None, None, 2), ("z", 5, "w", 2)], NARROW)
    columns = ["user_score", "user_feedback"]
    got = rows(log_table.update(base, changes, "id", columns, "v"))
    assert got == [("a", None, None, 1), ("b", 2, "y", 1)]
    assert rows(log_table.unmatched(base, changes, "id").select("id")) == [("z",)]
    assert log_table.matched_count(base, changes, "id") == 1


def test_feedback_intake(spark):
    log = spark.createDataFrame([("a",), ("b",)], "id string")
    sent = spark.createDataFrame([("a", 5), ("a", 0), ("q", 3), ("b", None)], "id string, score int")
    got = rows(log_table.feedback_intake(log, sent).select("id", "outcome"))
    assert got == [("a", "invalid_score"), ("a", "saved"), ("b", "invalid_score"), ("q", "unknown_session")]


def test_reads(spark):
    log = spark.createDataFrame(
        [(f"s{i}", i if i % 3 else None, i % 4, "coffee,fee" if i % 2 else None) for i in range(10)],
        "id string, user_score int, created_at int, tags string",
    )
    page = [r.id for r in log_table.recent(log, 3, 2).collect()]
    assert page == ["s2", "s6", "s1"]
    assert log_table.by_score(log).count() == 10
    assert log_table.by_score(log, 4, 7, "user_score").count() == 3
    assert log_table.unrated(log, 2).count() == 2 and log_table.unrated(log, None).count() == 4
    assert rows(log_table.by_id(log, "s3").select("id")) == [("s3",)]
    assert log.filter(log_table.has_tag(F.col("tags"), "FE")).count() == 5
    assert log.filter(log_table.has_tag(F.col("tags"), "offee", exact=True)).count() == 0


def test_result_summary(spark):
    got = log_table.result_summary(spark.range(9).withColumnRenamed("id", "n"), ["n"]).first()
    assert got.row_count == 9 and got["columns"] == "n"
    assert got["sample"] == '{"n":0}\n{"n":1}\n{"n":2}'


def _log(spark, *entries):
    columns = ["id", "question", "created_at", "user_score"]
    data = [(i, q, dt.datetime(2024, 1, day), score) for i, q, day, score in entries]
    df = spark.createDataFrame(data, "id string, question string, created_at timestamp, user_score int")
    missing = [f for f in log_table.LOG_STRUCT.fields if f.name not in columns]
    full = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    return full.select(*log_table.LOG_STRUCT.fieldNames())


def test_versioned_table(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"))
    assert table.current_version() == 0 and rows(table.read()) == []
    assert table.upsert(_log(spark, ("a", "one", 1, None))) == 1
    change = _log(spark, ("a", "two", 2, 4), ("b", "new", 2, None))
    assert table.upsert(change) == 2
    assert rows(table.read().select("id", "question")) == [("a", "two"), ("b", "new")]
    table.upsert(change, version=2)  # a repeated batch
    assert table.current_version() == 2
    assert rows(table.read().select("id", "question")) == [("a", "two"), ("b", "new")]
    assert table.compact() == 2
    table.upsert(_log(spark, ("c", "later", 3, None), ("b", "newer", 1, None)))
    expected = [("a", "two"), ("b", "newer"), ("c", "later")]
    assert rows(table.read().select("id", "question")) == expected
    assert table.compact() == 3 and rows(table.read().select("id", "question")) == expected


def test_old_copies_are_removed_and_reads_open_only_what_counts(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"))
    for day in (1, 2, 3):
        table.upsert(_log(spark, ("a", f"q{day}", day, None)))
        table.compact()
    assert table.versions("full") == [2, 3] and table.versions("changes") == [3]
    table.upsert(_log(spark, ("b", "new", 4, None)))
    files = [f.rsplit("log/", 1)[1].split("/part")[0] for f in table.read().inputFiles()]
    assert sorted(files) == ["changes/version=4", "full/version=3"]
    assert rows(table.read().select("id", "question")) == [("a", "q3"), ("b", "new")]


def test_log_by_time_keeps_the_newest_row(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"), order=("created_at", "version"))
    table.upsert(_log(spark, ("a", "newer", 5, None)))
    table.upsert(_log(spark, ("a", "older", 2, None), ("b", "x", 1, None)))
    assert rows(table.read().select("id", "question")) == [("a", "newer"), ("b", "x")]


def test_streams_get_versions_of_their_own(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"))
    assert [table.version_of("x", 0), table.version_of("y", 0), table.version_of("x", 0), table.version_of("x", 1)] == [1, 2, 1, 3]
    table.upsert(_log(spark, ("a", "one", 1, None)), version=7)
    assert [table.version_of("x", n) for n in (2, 3, 2)] == [8, 9, 8]


# --- statistics ---------------------------------------------------------------------------------------

STATS = "id string, self_score double, user_score int, latency_ms double, total_tokens int, error_count int"


def test_stats_of_an_empty_log(spark):
    got = evaluation.stats(spark.createDataFrame([], STATS)).first()
    assert got.total_queries == 0 and got.avg_self_score is None and float(got.error_rate) == 0


def test_rated_count_is_exact(spark):
    log = spark.createDataFrame([("a", 1.0, 3, 1.0, 1, 0), ("b", 1.0, None, 1.0, 1, 1), ("c", 1.0, None, 1.0, 2, 0)], STATS)
    got = evaluation.feedback_stats(log).first()
    assert (got.rated_queries, got.unrated_queries) == (1, 2)
    assert float(got.feedback_rate) == 33.3 and got.score_correlation is None
    assert float(evaluation.stats(log).first().error_rate) == 33.3


@pytest.mark.parametrize(
    "pairs, r, label",
    [
        ([(1, 1), (2, 2)], None, None),
        ([(5, 1), (5, 2), (5, 3)], None, None),
        ([(1, 1), (2, 2), (3, 3), (None, 4)], 1.0, "strong"),
        ([(1, 3), (2, 2), (3, 1)], -1.0, "strong"),
        ([(1, 1), (2, 3), (3, 2)], 0.5, "moderate"),
    ],
)
def test_correlation(spark, pairs, r, label):
    data = [(None if a is None else float(a), b) for a, b in pairs]
    got = evaluation.correlation(spark.createDataFrame(data, "self_score double, user_score int")).first()
    assert (got.r, got.label) == (r, label)


def test_insights(spark):
    log = spark.createDataFrame(
        [("a", 1, 1, 0, "first", 1), ("b", 2, 0, 3, "second", 2), ("c", 5, 1, 0, "no", 3), ("d", 2, 0, None, "", 4)],
        "id string, user_score int, error_count int, row_count int, user_feedback string, created_at int",
    )
    got = evaluation.improvement_insights(log).first()
    assert tuple(got) == (3, 1, 2, "second; first")
    none = evaluation.improvement_insights(log.filter("user_score > 4")).first()
    assert none.low_rated == 0 and not none.themes
