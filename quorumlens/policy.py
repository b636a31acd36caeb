"""Privacy and cost rules that every governed query obeys."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens import lineage


class PolicyViolation(ValueError):
    """A query or a result breaks the governance policy."""


@dataclass(frozen=True)
class GovernancePolicy:
    """Thresholds and limits; the defaults suit small demo data, raise ``k`` in production."""

    k: int = 5
    limit: int = 100
    max_rows: int = 200
    window_days: int = 90
    discovery_limit: int = 50
    forbidden: tuple[str, ...] = ("customer_id", "account_id")
    #: Columns that tell single rows apart; they may be aggregated, not listed.
    row_level: tuple[str, ...] = ("event_id", "event_ts", "event_amount", "balance_after")
    require_aggregation: bool = True
    #: Column of the persons or accounts that a group of guarded SQL must have ``k`` of; None leaves groups as they are.
    entity: str | None = "account_id"

    def forbidden_in(self, columns: Iterable[str]) -> list[str]:
        """Columns of a result that are identifiers, compared without case."""
        blocked = {name.lower() for name in self.forbidden}
        return [c for c in columns if c.lower() in blocked]

    def check_columns(self, df: DataFrame) -> DataFrame:
        """Refuse a result that carries an identifier column; no job is started."""
        found = self.forbidden_in(df.columns)
        if found:
            raise PolicyViolation(f"PRIVACY VIOLATION: Forbidden columns in output: {found}")
        return df

    def check_origins(self, df: DataFrame) -> DataFrame:
        """Refuse a result whose values or conditions give away identifiers or single rows; no job is started.

        An identifier may be counted and joined with the like column of another table, under any name; no
        condition may compare it with anything else. A row-level column may be summed up or cut to a period
        of a day or more; the smallest, the largest, a list or a histogram of it show single rows.
        """
        blocked = {name.lower() for name in self.forbidden}
        listed = {name.lower() for name in self.row_level}
        shown, compared = lineage.trace(df)
        for column, found in shown.items():
            for name, how in sorted(found):
                if name in blocked:
                    raise PolicyViolation(f"PRIVACY VIOLATION: {column} shows values of {name}")
                if self.require_aggregation and name in listed and how in (lineage.PLAIN, lineage.EXTREME):
                    raise PolicyViolation(f"row-level results are not allowed; {column} lists {name}")
        for name in sorted(compared & blocked):
            raise PolicyViolation(f"PRIVACY VIOLATION: a condition picks rows by {name}")
        return df

    def check_aggregated(self, df: DataFrame) -> DataFrame:
        """Refuse a result that shows table rows as they are; no job is started."""
        plan = df._jdf.queryExecution().analyzed()
        if self.require_aggregation and not _summarises(plan):
            raise PolicyViolation("row-level results are not allowed; aggregate the data")
        return df


def cut(df: DataFrame, rows: int | None) -> DataFrame:
    """The first rows of an ordered result, marked: total_rows, and whether rows were left out.

    Without a number the whole result is given as it is.
    """
    if rows is None:
        return df
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.limit(rows).withColumn("total_rows", total).withColumn("truncated", F.col("total_rows") > rows)


def _summarises(plan, ctes: dict[int, bool] | None = None) -> bool:
    """Whether every table below a logical plan node passes through a grouping."""
    ctes = {} if ctes is None else ctes
    kind = plan.nodeName()
    if kind == "WithCTE":
        parts = plan.cteDefs()
        for part in (parts.apply(i) for i in range(parts.size())):
            ctes[part.id()] = _summarises(part.child(), ctes)
        return _summarises(plan.plan(), ctes)
    if kind in ("Aggregate", "Distinct"):
        return True
    children = plan.children()
    if children.isEmpty():
        return kind == "OneRowRelation" or (kind == "CTERelationRef" and ctes.get(plan.cteId(), False))
    return all(_summarises(children.apply(i), ctes) for i in range(children.size()))
