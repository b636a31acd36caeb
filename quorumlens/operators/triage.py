"""Triage of whole columns of questions, SQL texts and outputs.

Each operator first computes what its rules share (the lower-case text, keyword hits, …) as columns of
their own, so that Spark evaluates them once per row and not once per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.functions import textguard
from quorumlens.plans.schema import EVENTS


def scope(df: DataFrame, question: str, output: str = "scope") -> DataFrame:
    """Add struct(status, reason, confidence, allowed) of a question column."""
    q = F.col("lower_")
    found = df.withColumn("lower_", F.lower(question)).withColumns(
        {
            "off_": textguard.off_topic(q),
            "hits_": textguard.analytics_hits(q),
            "asks_": textguard.asks(q),
        }
    )
    verdict = textguard.scope(F.col("off_"), F.col("hits_"), F.col("asks_"))
    return found.withColumn(output, verdict).drop("lower_", "off_", "hits_", "asks_")


def sql(
    df: DataFrame,
    text: str,
    output: str = "verdict",
    known: Sequence[str] = EVENTS.names(),
    strict: bool = False,
) -> DataFrame:
    """Add struct(status, reason, allowed) and ``warnings`` of a SQL text column."""
    upper = F.upper(textguard.strip(F.col(text)))
    staged = df.withColumns(
        {"upper_": upper, "unknown_": textguard.unknown_columns(F.col(text), known)}
    ).withColumns(
        {
            "refusal_": textguard.refusal(F.col("upper_"), strict),
            "warnings": textguard.warnings(F.col("upper_"), F.col("unknown_")),
        }
    )
    verdict = textguard.verdict(F.col("refusal_"), F.col("warnings"))
    return staged.withColumn(output, verdict).drop("upper_", "unknown_", "refusal_")


def pii(df: DataFrame, text: str, output: str = "pii") -> DataFrame:
    """Add struct(safe, reason) of a text column."""
    lowered = df.withColumn("lower_", F.lower(text))
    found = textguard.pii(F.col(text), F.col("lower_"))
    return lowered.withColumn(output, found).drop("lower_")
