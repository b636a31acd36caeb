import datetime as dt

import pytest
from pyspark.sql import functions as F

from quorumlens.sources import sessions
from quorumlens.sources.log_table import LogTable
from quorumlens.streaming import jobs
from suite import all_queries
from tests.conftest import rows
from tests.test_log import _log

QUERIES = all_queries()[0]
EVENTS = "id int, ts timestamp, user string, kind string, value int"


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def _feed(spark, path, *batches):
    """One file per batch, in order; the stream takes one file per micro-batch."""
    for batch in batches:
        df = spark.createDataFrame([(i, _at(m), u, k, v) for i, m, u, k, v in batch], EVENTS)
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_late_rows_never_change_a_closed_window(spark, tmp_path):
    stream = _feed(
        spark, tmp_path,
        [(1, 1, "a", "x", 1), (2, 2, "b", "x", 2)],
        [(3, 200, "a", "x", 4)],
        [(6, 210, "a", "x", 16)],
        [(4, 3, "c", "x", 100)],  # its window was published before
        [(5, 400, "c", "x", 8)],
    )
    out = jobs.windowed(stream, "ts", [F.sum("value").alias("v")], "1 hour", delay="10 minutes")
    got = rows(jobs.drain(out, "t").select("window_start", "v"))
    assert got == [(_at(0), 3), (_at(180), 20)]


def test_counters_equal_batch(spark, tmp_path):
    stream = _feed(spark, tmp_path, [(1, 1, "a", "x", 1), (2, 1, "a", "y", 5)], [(3, 2, "a", "x", 3)])
    got = rows(jobs.drain(jobs.counters(stream, "kind", "value"), "c", "complete"))
    assert got == [("x", 2, 4, 2.0), ("y", 1, 5, 5.0)]


def test_sessions(spark, tmp_path):
    stream = _feed(spark, tmp_path, [(1, 0, "a", "x", 1), (2, 4, "a", "x", 1), (3, 20, "a", "x", 1)], [(4, 300, "z", "x", 1)])
    out = jobs.sessions(stream, "user", "ts", "5 minutes", [F.count("*").alias("n")])
    assert rows(jobs.drain(out, "s").select("user", "n")) == [("a", 1), ("a", 2)]


def test_pairing_flags_unfinished_starts(spark, tmp_path):
    stream = _feed(
        spark, tmp_path,
        [(1, 0, "a", "start", 0), (2, 1, "a", "start", 0)],
        [(1, 3, "a", "end", 0)],
        [(9, 500, "a", "start", 0), (8, 500, "a", "end", 0)],
        [(10, 501, "a", "start", 0), (11, 501, "a", "end", 0)],
    )
    starts = stream.filter("kind = 'start'").select("id", F.col("ts").alias("start_ts"))
    ends = stream.filter("kind = 'end'").select("id", F.col("ts").alias("end_ts"))
    got = rows(jobs.drain(jobs.pair(starts, ends, "id", "5 minutes"), "p").select("id", "end_ts"))
    assert got == [(1, _at(3)), (2, None)]


@pytest.mark.parametrize("k, expected", [(2, [("x", 2, 3, 6)]), (3, [])])
def test_k_anonymity_counts_entities_exactly(spark, tmp_path, k, expected):
    stream = _feed(
        spark, tmp_path,
        [(1, 1, "a", "x", 1), (2, 2, "a", "x", 2), (3, 2, "a", "y", 9)],
        [(4, 3, "b", "x", 3)],
        [(5, 900, "c", "x", 1)],
    )
    out = jobs.k_anon_stream(stream, "ts", ["kind"], "user", k, "1 hour", "value")
    assert rows(jobs.drain(out, "k").select("kind", "entities", "n_events", "total")) == expected


def test_redaction_and_triage(spark, tmp_path):
    stream = _feed(spark, tmp_path, [(1, 1, "write to a@b.cd", "show the monthly fee", 1)])
    got = jobs.drain(jobs.redact(jobs.classify(stream, "kind"), "user"), "r").first()
    assert got.user == "write to [EMAIL REDACTED]"
    assert got.scope.status == "in_scope" and got.intent == "trend"


@pytest.mark.parametrize("name, key", [("documents", "stream_redact"), ("conversations", "stream_triage"), ("events", "stream_counters")])
def test_tables_of_several_files_are_streamed_whole(spark, folder, tmp_path, name, key):
    """A table is a folder of files as soon as it is written by more than one task."""
    spark.read.parquet(f"{folder}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    parts, whole = (rows(QUERIES[key](spark, path)) for path in (str(tmp_path), folder))
    assert parts == whole and whole


def test_batches_merge_into_the_log(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"))
    merge = jobs.upsert_batches(table)
    merge(_log(spark, ("a", "one", 1, None)), 0)
    merge(_log(spark, ("a", "two", 2, 3), ("b", "x", 2, None)), 1)
    merge(_log(spark, ("a", "two", 2, 3), ("b", "x", 2, None)), 1)  # replay
    assert table.current_version() == 2
    assert rows(table.read().select("id", "question")) == [("a", "two"), ("b", "x")]


def test_log_stream_end_to_end(spark, tmp_path):
    for i, day in enumerate((1, 2, 3)):
        _log(spark, ("a", f"q{day}", day, i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = LogTable(spark, str(tmp_path / "log"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), table.struct)
    query = (
        stream.writeStream.foreachBatch(jobs.upsert_batches(table))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows(table.read().select("id", "question")) == [("a", "q3")]


def test_session_documents_as_a_stream(spark, tmp_path):
    ddl = "session_id string, timestamp timestamp, errors array<string>"
    (tmp_path / "in").mkdir()
    for i in range(2):
        text = f'{{"session_id": "s{i}", "timestamp": "2024-01-01T00:0{i}:00", "errors": ["e"]}}'
        (tmp_path / "in" / f"2024-01-01_s{i}.json").write_text(text)
    stream = jobs.read_sessions(spark, str(tmp_path / "in"), ddl)
    assert rows(jobs.drain(stream.select("session_id"), "sessions")) == [("s0",), ("s1",)]


def test_session_stream_is_merged_once_and_newest_first(spark, tmp_path):
    path, table = str(tmp_path / "in"), LogTable(spark, str(tmp_path / "log"), order=("created_at", "version"))

    def put(*documents):
        kinds = f"session_id string, question string, timestamp timestamp, traces array<{sessions.TRACE}>, errors array<string>"
        rows_ = [(i, q, dt.datetime(2024, 1, 1, hour), None, errors) for i, q, hour, errors in documents]
        sessions.write(spark.createDataFrame(rows_, kinds).coalesce(1), path)

    put(("s1", "first", 1, ["e"]), ("s2", "two", 2, None), ("s1", "first", 1, ["e"]), (None, "nobody", 3, None))
    stream = jobs.read_sessions(spark, path, sessions.SESSION_DDL)
    jobs.merge_sessions(stream, table, "main")
    put(("s1", "second", 5, []), ("s2", "early", 1, None))
    put(("s1", "first", 1, ["e"]))
    jobs.merge_sessions(stream, table, "main")
    expected = [("s1", "second", 0), ("s2", "two", 0)]
    assert rows(table.read().select("id", "question", "error_count")) == expected
    jobs.merge_sessions(stream, table, "again")
    assert rows(table.read().select("id", "question", "error_count")) == expected
