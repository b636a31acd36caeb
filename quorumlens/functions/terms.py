"""Business terms as predicates and metrics as aggregate columns.

Each entry is a native ``Column``, so the same metric works globally, grouped by any dimension and
inside a larger ``agg`` call without a second pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlens.plans.schema import EVENTS, EventSchema


def _movement(s: EventSchema) -> Column:
    return F.col(s.event_type) == "money_movement"


def _inflow(s: EventSchema) -> Column:
    return (F.col(s.amount) > 0) & _movement(s)


def _outflow(s: EventSchema) -> Column:
    return (F.col(s.amount) < 0) & _movement(s)


_PREDICATES: dict[str, Callable[[EventSchema], Column]] = {
    "deposits": _inflow,
    "withdrawals": _outflow,
    "transactions": _movement,
    "fees": lambda s: F.col(s.event_type) == "fee",
    "interest": lambda s: F.col(s.event_type) == "interest",
    "inflow": _inflow,
    "outflow": _outflow,
    "accounts_opened": lambda s: F.col(s.event_name) == "account_opened",
}


def predicate(term: str, schema: EventSchema = EVENTS) -> Column:
    """Row predicate of a business term."""
    return _PREDICATES[term](schema)


def terms() -> tuple[str, ...]:
    return tuple(_PREDICATES)


def sum_if(condition: Column, value: Column) -> Column:
    """Sum over matching rows; NULL when no row matches."""
    return F.sum(F.when(condition, value))


def sum_else_zero(condition: Column, value: Column) -> Column:
    """Sum that treats other rows as zero, so it is 0 when no row matches."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE; NULL instead of an error when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def _amount(s: EventSchema) -> Column:
    return F.col(s.amount)


def _per_customer(s: EventSchema) -> Column:
    return ratio(F.count_if(_movement(s)), F.countDistinct(s.customer))


def _digital_share(s: EventSchema) -> Column:
    return ratio(F.lit(100.0) * F.count_if(F.col(s.channel) == "DIGITAL"), F.count(F.lit(1)))


_METRICS: dict[str, Callable[[EventSchema], Column]] = {
    "total_deposits": lambda s: sum_if(_inflow(s), _amount(s)),
    "total_withdrawals": lambda s: F.abs(sum_if(_outflow(s), _amount(s))),
    "net_flow": lambda s: sum_if(_movement(s), _amount(s)),
    "transaction_count": lambda s: F.count_if(_movement(s)),
    "active_customers": lambda s: F.countDistinct(s.customer),
    "avg_transactions_per_customer": _per_customer,
    "digital_adoption_rate": _digital_share,
    "total_fees": lambda s: F.abs(sum_if(predicate("fees", s), _amount(s))),
    "fee_events": lambda s: F.count_if(predicate("fees", s)),
    "alt_deposits": lambda s: sum_else_zero(_amount(s) > 0, _amount(s)),
    "alt_withdrawals": lambda s: sum_else_zero(_amount(s) < 0, F.abs(_amount(s))),
    "event_count": lambda s: F.count(F.lit(1)),
    "unique_customers": lambda s: F.countDistinct(s.customer),
}


def metric(name: str, schema: EventSchema = EVENTS) -> Column:
    """Aggregate column of a named metric, aliased with the metric's name."""
    return _METRICS[name](schema).alias(name)


#: Names of the knowledge base that differ from the metric's own name (fixed values).
_OTHER_NAMES = {"total_fees_collected": "total_fees", "fee_events_count": "fee_events"}


def metric_name(text: str) -> str | None:
    """A metric by its own name or by the one of the knowledge base, such as ``Net Flow``."""
    plain = "_".join(text.lower().split())
    plain = _OTHER_NAMES.get(plain, plain)
    return plain if plain in _METRICS else None


def metrics() -> tuple[str, ...]:
    return tuple(_METRICS)
