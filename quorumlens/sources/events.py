"""Readers that register an event table, and governed pass-through SQL over it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens import threshold
from quorumlens.functions import textguard
from quorumlens.operators import triage
from quorumlens.plans.schema import EVENT_STRUCT
from quorumlens.policy import GovernancePolicy, PolicyViolation

#: The event file as queries quote it (fixed value).
_QUOTED_FILE = re.compile(r"'data/sample_events\.csv'", re.IGNORECASE)

_STRFTIME_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD"}
_PATTERN = "f"
for _from, _to in _STRFTIME_PARTS.items():
    _PATTERN = f"replace({_PATTERN}, '{_from}', '{_to}')"
_STRFTIME = (
    "CREATE OR REPLACE TEMPORARY FUNCTION strftime(t TIMESTAMP, f STRING) RETURNS STRING "
    f"RETURN date_format(t, {_PATTERN})"
)

_BROKEN = "_corrupt_record"

#: A table of events answers to both names.
VIEW_NAMES = ("events", "sample_events")


def register(df: DataFrame, names: tuple[str, ...] = VIEW_NAMES) -> DataFrame:
    """Make one plan available to SQL under several names."""
    for name in names:
        df.createOrReplaceTempView(name)
    return df


def read_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """CSV with a header; declared types by default, so the files are read once."""
    reader = spark.read.option("header", True)
    if infer:
        return register(reader.option("inferSchema", True).csv(path))
    return register(reader.schema(EVENT_STRUCT).csv(path))


def read_csv_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of CSV with a header: rows of the declared types, and the text of lines that are not such rows.

    A line with too few or too many fields, or with a value that is not of its column's type, is rejected whole.
    Blank lines are skipped. Only the accepted rows are registered.
    """
    broken = T.StructField(_BROKEN, T.StringType())
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "columnPruning": False}
    reader = spark.read.options(**options)
    rows = reader.schema(T.StructType([*EVENT_STRUCT.fields, broken])).csv(path)
    # Always true; without it only the columns that a query uses would be read, and only their values checked.
    whole = F.xxhash64(*EVENT_STRUCT.names) >= F.lit(-(1 << 63))
    good = rows.filter(F.col(_BROKEN).isNull() & whole).drop(_BROKEN)
    return register(good), rows.filter(F.col(_BROKEN).isNotNull() & whole).select(F.col(_BROKEN).alias("line"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return register(spark.read.parquet(path))


def register_file(spark: SparkSession, name: str, path: str) -> None:
    """Make a CSV file with a header usable in SQL under a name."""
    spark.read.option("header", True).option("inferSchema", True).csv(path).createOrReplaceTempView(
        name
    )


def check_sql(spark: SparkSession, sql: str, strict: bool = True) -> str:
    """Sanitised text of an acceptable query; a rejected one raises with the reason."""
    text = spark.range(1).select(F.lit(sql).alias("sql"))
    checked = triage.sql(text, "sql", "v", strict=strict)
    row = checked.select("v", textguard.sanitize(F.col("sql")).alias("clean")).first()
    if not row.v.allowed:
        raise PolicyViolation(row.v.reason)
    return row.clean


def query(
    spark: SparkSession, sql: str, policy: GovernancePolicy = GovernancePolicy()
) -> DataFrame:
    """Run guarded SQL in Spark's dialect over the registered views; the whole result is given.

    The text is checked first, then the result's columns, where their values come from, what its conditions
    compare, and that it shows no raw rows. Groups of fewer than ``policy.k`` entities are left out, at every
    grouping of the text. A quoted event file stands for the events, and ``strftime`` is known. Errors of the
    analysis are raised, not turned into an empty result.
    """
    text = _QUOTED_FILE.sub(VIEW_NAMES[0], check_sql(spark, sql))
    if re.search(r"\bstrftime\s*\(", text, re.IGNORECASE):
        spark.sql(_STRFTIME)
    result = spark.sql(text)
    policy.check_origins(policy.check_aggregated(policy.check_columns(result)))
    return result if policy.entity is None else threshold.with_threshold(result, policy.entity, policy.k)


def query_pandas(
    spark: SparkSession, sql: str, policy: GovernancePolicy = GovernancePolicy()
) -> pd.DataFrame:
    """The same result as a local table of at most ``policy.max_rows`` rows, in the query's order.

    ``attrs`` of the table says how many rows there were (total_rows) and whether some were left out (truncated).
    """
    result = query(spark, sql, policy)
    frame = result.limit(policy.max_rows + 1).toPandas()
    more = len(frame) > policy.max_rows
    frame = frame.head(policy.max_rows)
    frame.attrs.update(total_rows=result.count() if more else len(frame), truncated=more)
    return frame
