"""Session documents with nested traces: JSON sink and source, and their flat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = (
    "struct<agent_name: string, action: string, timestamp: timestamp, duration_ms: double, "
    "tokens_used: int, input_summary: string, output_summary: string, error: string, "
    "details: map<string,string>>"
)
SESSION_DDL = (
    f"session_id string, question string, timestamp timestamp, traces array<{TRACE}>, "
    "errors array<string>"
)


def write(sessions: DataFrame, path: str) -> None:
    """Append session documents below one folder per date."""
    dated = sessions.withColumn("date", F.to_date("timestamp"))
    dated.write.mode("append").partitionBy("date").json(path)


#: Column that holds the text of a document that does not fit the schema.
CORRUPT = "_corrupt_record"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents that fit the schema."""
    return read_checked(spark, path)[0]


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): ``rejected`` has date and text of each line that is no session document."""
    ddl = f"{SESSION_DDL}, date date, {CORRUPT} string"
    rows = spark.read.schema(ddl).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    # Always true; without it only the columns that a query uses would be read, and only their values checked.
    whole = F.xxhash64("session_id", "question", "timestamp", F.size("traces"), "errors") >= F.lit(-(1 << 63))
    rejected = rows.filter(F.col(CORRUPT).isNotNull() & whole).select("date", F.col(CORRUPT).alias("text"))
    return rows.filter(F.col(CORRUPT).isNull() & whole).drop(CORRUPT), rejected


def traces(sessions: DataFrame) -> DataFrame:
    """One row per trace of each session, with its position."""
    exploded = sessions.select("session_id", F.posexplode("traces").alias("position", "t"))
    return exploded.select("session_id", "position", "t.*")


def error_texts(traces: Column, errors: Column) -> Column:
    """Errors of traces, then of their session, each text once."""
    failed = F.filter(traces, lambda t: t["error"].isNotNull())
    texts = F.transform(failed, lambda t: F.concat(t["agent_name"], F.lit(": "), t["error"]))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(texts, empty), F.coalesce(errors, empty)))


def all_errors(sessions: DataFrame) -> DataFrame:
    """Session errors joined with the errors of its traces, each text once."""
    return sessions.withColumn("errors", error_texts(F.col("traces"), F.col("errors")))


def errors_by_session(sessions: DataFrame) -> DataFrame:
    """session_id, n_documents, errors: each error text of all documents of a session once, in order."""
    texts = all_errors(sessions).select("session_id", F.explode_outer("errors").alias("error"))
    # A text that comes in very many documents is one row per task before the sets are put together.
    single = texts.distinct()
    documents = sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_documents"))
    sets = single.groupBy("session_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    return documents.join(sets, "session_id")
