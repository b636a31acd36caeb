"""Roles of the columns of an event table."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

#: Declared type of every role; declaring it avoids an inference pass over the files.
EVENT_TYPES = {
    "event_id": T.StringType(),
    "event_ts": T.TimestampType(),
    "event_date": T.DateType(),
    "account_id": T.StringType(),
    "customer_id": T.StringType(),
    "product_type": T.StringType(),
    "event_type": T.StringType(),
    "event_name": T.StringType(),
    "channel": T.StringType(),
    "event_amount": MONEY,
    "currency": T.StringType(),
    "balance_after": MONEY,
}

EVENT_STRUCT = T.StructType([T.StructField(n, t) for n, t in EVENT_TYPES.items()])


@dataclass(frozen=True)
class EventSchema:
    """Which column of a table plays which role. Every operator reads columns through this."""

    event_id: str = "event_id"
    ts: str = "event_ts"
    date: str = "event_date"
    account: str = "account_id"
    customer: str = "customer_id"
    product: str = "product_type"
    event_type: str = "event_type"
    event_name: str = "event_name"
    channel: str = "channel"
    amount: str = "event_amount"
    currency: str = "currency"
    balance: str = "balance_after"

    @property
    def entity(self) -> str:
        """The column whose distinct values are counted against ``k``."""
        return self.account

    def names(self) -> tuple[str, ...]:
        return tuple(getattr(self, f.name) for f in fields(self))

    def month(self) -> Column:
        return grain(F.col(self.date), "month")


EVENTS = EventSchema()

#: Label patterns of the date grains whose label is a plain date format.
_GRAIN_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def grain(date: Column, unit: str) -> Column:
    """Label of the period a date falls into: day, week, month, quarter or year."""
    if unit in _GRAIN_FORMATS:
        return F.date_format(date, _GRAIN_FORMATS[unit])
    if unit == "week":
        return F.date_format(F.date_trunc("week", date), "yyyy-MM-dd")
    if unit == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))
    raise ValueError(f"unknown time grain: {unit}")


def latest(df: DataFrame, date: str) -> Column:
    """Newest date of the whole table as a scalar subquery, so Spark computes it once."""
    return df.agg(F.max(date)).scalar()
