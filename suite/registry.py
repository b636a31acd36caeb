"""Registry of queries and of the SQL with the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite.bindings import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(
    key: str, sql: str | None = None, views: str = "", recursive: bool = False
) -> Callable[[Query], Query]:
    """Register a query; ``views`` names the derived views its SQL uses."""

    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, folder))

        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql, *views.split(), recursive=recursive) if views else sql
        return fn

    return keep


def plain(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE and all integers as BIGINT, after all arithmetic is done exactly."""

    def cast(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(field.name).cast("bigint").alias(field.name)
        return F.col(field.name)

    return df.select(*[cast(f) for f in df.schema.fields])
