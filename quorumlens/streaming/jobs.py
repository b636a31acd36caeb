"""Structured Streaming forms of the log, trace and privacy operators.

Event times are TIMESTAMP: cast a timestamp without time zone before setting a watermark. Windowed
results are final when the watermark passes their end, so late rows never change a published group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.functions import textguard
from quorumlens.operators import triage
from quorumlens.operators.privacy import ENTITIES
from quorumlens.session import scratch_path
from quorumlens.sources import sessions as sessions_source
from quorumlens.sources.log_table import LOG_STRUCT, LogTable

Batch = Callable[[DataFrame, int], None]


def read_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream of the Parquet files of a table: those that appear below a folder, or one file."""
    # A stream takes a plain path for a folder; a pattern may also name a file. This one matches the path alone.
    start, last = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    return spark.readStream.schema(schema).parquet(f"{start}[{last}]")


def read_sessions(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Stream of session documents that appear below a folder, as :func:`sessions.write` writes them."""
    return spark.readStream.schema(ddl).json(path)


def ended(stream: DataFrame, ts: str, **keys: object) -> DataFrame:
    """A finite stream with a marker row far in the future, so that its watermark passes all real rows.

    Windows, sessions and pairs of the newest rows are then given too; the marker's own window never closes.
    Its columns are null but for ``keys``: a join drops null keys early, so give the marker a key that no row has.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, "end-of-input")
    values = {ts: "2200-01-01", **keys}
    empty = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*empty).write.parquet(folder)
    return stream.unionByName(read_files(spark, folder, stream.schema))


def counters(stream: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Running count, sum and average per name, for ``complete`` or ``update`` output."""
    return stream.groupBy(name).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average")
    )


def windowed(
    stream: DataFrame,
    ts: str,
    aggs: Sequence[Column],
    size: str,
    slide: str | None = None,
    delay: str = "10 minutes",
    dims: Sequence[str] = (),
) -> DataFrame:
    """Aggregates per tumbling or sliding window."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = stream.withWatermark(ts, delay).groupBy(window.alias("window"), *dims)
    return _flat(grouped.agg(*aggs))


def sessions(
    stream: DataFrame, key: str, ts: str, gap: str, aggs: Sequence[Column], delay: str = "10 minutes"
) -> DataFrame:
    """Aggregates per key and session: rows at most ``gap`` apart belong together."""
    window = F.session_window(ts, gap).alias("window")
    return _flat(stream.withWatermark(ts, delay).groupBy(window, key).agg(*aggs))


def pair(
    starts: DataFrame, ends: DataFrame, key: str, within: str, delay: str = "10 minutes"
) -> DataFrame:
    """Each start with its completion, or with NULL once none can come any more.

    ``starts`` has key and start_ts, ``ends`` has key and end_ts; the key names one operation.
    """
    left = starts.withWatermark("start_ts", delay).alias("s")
    right = ends.withWatermark("end_ts", delay).alias("e")
    in_time = F.expr(f"e.end_ts BETWEEN s.start_ts AND s.start_ts + INTERVAL {within}")
    joined = left.join(right, (F.col(f"s.{key}") == F.col(f"e.{key}")) & in_time, "left")
    return joined.select(F.col(f"s.{key}").alias(key), "start_ts", "end_ts")


def k_anon_stream(
    stream: DataFrame,
    ts: str,
    dims: Sequence[str],
    entity: str,
    k: int,
    size: str,
    amount: str,
    delay: str = "10 minutes",
) -> DataFrame:
    """k-anonymous count and sum per window and dims, with an exact number of entities.

    Streams have no exact distinct count, so rows are first combined per (window, dims, entity) and
    the resulting one row per entity is counted by a second stateful step.
    """
    window = F.window(ts, size).alias("window")
    per_entity = (
        stream.withWatermark(ts, delay)
        .groupBy(window, *dims, entity)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
    )
    grouped = per_entity.groupBy(F.window(F.window_time("window"), size).alias("window"), *dims)
    totals = grouped.agg(
        F.count(F.lit(1)).alias(ENTITIES),
        F.sum("n").alias("n_events"),
        F.sum("amount").alias("total"),
    )
    return _flat(totals).filter(F.col(ENTITIES) >= k)


def redact(stream: DataFrame, text: str) -> DataFrame:
    """Stateless redaction of one column."""
    return stream.withColumn(text, textguard.redact(F.col(text)))


def classify(stream: DataFrame, question: str) -> DataFrame:
    """Stateless scope and intent of a question column."""
    return triage.scope(stream, question).withColumn("intent", textguard.intent(F.col(question)))


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
    )


# --- sinks ----------------------------------------------------------------------------------------


def upsert_batches(log: LogTable, stream: str = "stream") -> Batch:
    """foreachBatch sink that merges each batch into a log table.

    The log gives every batch of a stream a version of its own, so a batch that is replayed after a failure replaces
    its own earlier result, and no stream replaces another one's.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        log.upsert(batch, version=log.version_of(stream, batch_id))

    return merge


def merge_sessions(documents: DataFrame, log: LogTable, name: str, replays: str = "1 day") -> None:
    """Take in the session documents that are available now; a document that comes again within ``replays`` is left out.

    Replays are told by session and time of the document, and remembered by the time at which they come in, so no
    document is too late. With a log that is ordered by created_at, the newest document of a session is its log
    row, in whichever order they come. ``name`` names the stream: its progress is kept beside the log and goes on
    with the next call.
    """
    rows = log_rows(documents).withColumn("came_", F.current_timestamp()).withWatermark("came_", replays)
    fresh = rows.dropDuplicatesWithinWatermark(["id", "created_at"]).drop("came_")
    writer = fresh.writeStream.option("checkpointLocation", f"{log.path}/progress/{name}").trigger(availableNow=True)
    writer.foreachBatch(upsert_batches(log, name)).start().awaitTermination()


def log_rows(documents: DataFrame) -> DataFrame:
    """Rows of the query log from session documents; works on tables and on streams."""
    traces = F.coalesce("traces", F.array().cast(documents.schema["traces"].dataType))
    errors = sessions_source.error_texts(traces, F.col("errors"))
    known = {
        "id": F.col("session_id"),
        "question": F.coalesce("question", F.lit("")),
        "agent_traces_json": F.to_json(traces),
        "latency_ms": F.aggregate(traces, F.lit(0.0), lambda n, t: n + F.coalesce(t["duration_ms"], F.lit(0.0))),
        "total_tokens": F.aggregate(traces, F.lit(0), lambda n, t: n + F.coalesce(t["tokens_used"], F.lit(0))),
        "error_count": F.size(errors),
        "created_at": F.col("timestamp"),
    }
    named = documents.filter("session_id IS NOT NULL AND timestamp IS NOT NULL")
    return named.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_STRUCT.fields])


def _result(spark: SparkSession, schema: T.StructType, out: str) -> DataFrame:
    """What was written; an empty table when there was no batch to write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that is available now and return the result as a table.

    Results and progress are kept in the shared folder. ``complete`` and ``update`` modes keep one
    folder per batch, of which the table reads the newest (complete) or all of them (update).
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, name)
    out, progress = f"{folder}/out", f"{folder}/progress"
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(out).awaitTermination()
        return _result(spark, stream.schema, out)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_").parquet(out)

    writer.outputMode(mode).foreachBatch(store).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_", T.LongType())])
    table = _result(spark, schema, out)
    if mode == "complete":
        table = table.filter(F.col("batch_") == table.agg(F.max("batch_")).scalar())
    return table.drop("batch_")
