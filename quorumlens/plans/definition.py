"""A structured question (measures, dimensions, filters, time range) compiled to one aggregate."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.functions import terms
from quorumlens.operators.privacy import k_anon
from quorumlens.plans.schema import EVENTS, EventSchema, grain
from quorumlens.policy import GovernancePolicy, PolicyViolation, cut

GRAINS = ("day", "week", "month", "quarter", "year")

_FUNCTIONS = {
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.countDistinct,
}

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
    "IN": lambda c, v: c.isin(list(v)),
    "BETWEEN": lambda c, v: c.between(v[0], v[1]),
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class Measure:
    """``function`` over ``column`` ('*' for a row count), or a named metric of the semantic layer."""

    function: str
    column: str = "*"
    alias: str | None = None

    @property
    def name(self) -> str:
        plain = "rows" if self.column == "*" else self.column
        return self.alias or f"{self.function.lower()}_{plain}"

    def expression(self, schema: EventSchema) -> Column:
        named = terms.metric_name(self.function)
        if named is not None:
            return terms.metric(named, schema).alias(self.alias or named)
        if self.function.upper() not in _FUNCTIONS:
            raise ValueError(f"unknown metric or function: {self.function}")
        fn = _FUNCTIONS[self.function.upper()]
        return fn(F.lit(1) if self.column == "*" else F.col(self.column)).alias(self.name)


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str = "="
    value: Any = None

    def condition(self) -> Column:
        return _COMPARE[self.operator.upper()](F.col(self.column), self.value)


@dataclass(frozen=True)
class TimeRange:
    """Inclusive dates; either end may be open."""

    start: dt.date | None = None
    end: dt.date | None = None

    def condition(self, date: Column) -> Column:
        parts = []
        if self.start is not None:
            parts.append(date >= F.lit(self.start))
        if self.end is not None:
            parts.append(date <= F.lit(self.end))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Definition:
    measures: tuple[Measure, ...]
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    time_range: TimeRange = TimeRange()


def _date(text: Any) -> dt.date | None:
    if text is None or isinstance(text, dt.date):
        return text
    return None if text.lower() == "null" else dt.date.fromisoformat(text)


def _filter_of_condition(column: str, condition: Any) -> Filter:
    """One ``column: condition`` entry; the condition is a value, a list or text like ``> 0`` or ``IN ('a', 'b')``."""
    if isinstance(condition, (list, tuple)):
        return Filter(column, "IN", tuple(condition))
    if not isinstance(condition, str):
        return Filter(column, "=", condition)
    text = condition.strip()
    for pattern, operator in _TEXT_FORMS:
        match = pattern.fullmatch(text)
        if match:
            return Filter(column, operator or match[1].replace("<>", "!="), _VALUES[operator](match))
    if _LOOKS_LIKE_SQL.match(text):
        raise ValueError(f"unknown condition on {column}: {condition}")
    return Filter(column, "=", _unquoted(text))


def _unquoted(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace(text[0] * 2, text[0])
    return text


def _list(text: str) -> tuple[str, ...]:
    return tuple(_unquoted(m[0]) for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|[^,\s][^,]*", text))


#: Written forms of a condition; no operator means that the first group names it.
_TEXT_FORMS = tuple(
    (re.compile(pattern, re.IGNORECASE | re.DOTALL), operator)
    for pattern, operator in (
        (r"is\s+not\s+null", "IS NOT NULL"),
        (r"is\s+null", "IS NULL"),
        (r"in\s*\((.*)\)", "IN"),
        (r"like\s+(.+)", "LIKE"),
        (r"between\s+(\S+|'[^']*')\s+and\s+(\S+|'[^']*')", "BETWEEN"),
        (r"(>=|<=|!=|<>|=|>|<)\s*(.+)", None),
    )
)
_VALUES = {
    "IS NOT NULL": lambda m: None,
    "IS NULL": lambda m: None,
    "IN": lambda m: _list(m[1]),
    "LIKE": lambda m: _unquoted(m[1]),
    "BETWEEN": lambda m: (_unquoted(m[1]), _unquoted(m[2])),
    None: lambda m: _unquoted(m[2]),
}
_LOOKS_LIKE_SQL = re.compile(r"(?:not\s|in\s*\(|is\s|like\s|between\s|exists\s*\(|[<>=!~])", re.IGNORECASE)


def _filter_of_text(text: str) -> Filter | None:
    """A whole condition such as ``channel IN ('DIGITAL')``; a bare column name sets no condition."""
    match = re.fullmatch(r"\s*[\"'`]?(\w+)[\"'`]?\s*(.*)", text, re.DOTALL)
    if not match:
        raise ValueError(f"unknown filter: {text}")
    if not match[2].strip():
        return None
    if not _LOOKS_LIKE_SQL.match(match[2].lstrip()):
        raise ValueError(f"unknown filter: {text}")
    return _filter_of_condition(match[1], match[2])


def _measure_of_text(text: str) -> Measure:
    """A named metric, or ``FUNCTION(column)``."""
    match = re.fullmatch(r"\s*(\w+)\s*\(\s*(DISTINCT\s+)?([\w*]+)\s*\)\s*", text, re.IGNORECASE)
    if not match:
        return Measure(text)
    function = match[1].upper() + ("_DISTINCT" if match[2] else "")
    return Measure(function, match[3])


def _filter_of_struct(f: Mapping[str, Any]) -> Filter:
    operator, value = f.get("operator", "="), f.get("value")
    if operator.upper() not in _COMPARE:
        raise ValueError(f"unknown operator: {operator}")
    if isinstance(value, str) and operator.upper() == "IN":
        value = _list(value.strip().removeprefix("(").removesuffix(")"))
    return Filter(f["column"], operator, value)


#: Periods as they are written; those without a grain leave the dimensions as they are.
_PERIODS = {
    "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year", "annual": "year",
    "all_time": None, "all": None, "total": None, "none": None, "null": None, "": None, "custom": None, "etc": None,
}


def _grain_of(text: str | None) -> str | None:
    if text is None:
        return None
    plain = text.strip().lower().replace(" ", "_")
    if plain in GRAINS:
        return plain
    if plain not in _PERIODS:
        raise ValueError(f"unknown time grain or period: {text}")
    return _PERIODS[plain]


def normalise(spec: Mapping[str, Any]) -> Definition:
    """Read either written form of a definition: one ``metric`` struct, or a ``metrics`` list."""
    if "metric" in spec:
        m = spec["metric"]
        measures = (Measure(m["function"], m.get("column") or "*", m.get("alias")),)
    else:
        measures = tuple(_measure_of_text(t) for t in spec.get("metrics", ()))
    raw = spec.get("filters") or ()
    if isinstance(raw, Mapping):
        filters = tuple(_filter_of_condition(c, v) for c, v in raw.items())
    else:
        parts = [_filter_of_text(f) if isinstance(f, str) else _filter_of_struct(f) for f in raw]
        filters = tuple(f for f in parts if f is not None)
    times = spec.get("time_range") or {}
    dimensions = tuple(spec.get("dimensions") or ())
    for unit in (_grain_of(spec.get("time_grain")), _grain_of(times.get("period"))):
        if unit is not None and not set(dimensions) & set(GRAINS):
            dimensions = (unit, *dimensions)
    return Definition(
        measures, dimensions, filters, TimeRange(_date(times.get("start")), _date(times.get("end")))
    )


def _check(definition: Definition, policy: GovernancePolicy) -> None:
    if policy.forbidden_in(definition.dimensions):
        raise PolicyViolation("an identifier cannot be a dimension; ask for a distribution instead")
    for m in definition.measures:
        if policy.forbidden_in([m.column]) and m.function.upper() != "COUNT_DISTINCT":
            raise PolicyViolation("an identifier may only be counted as distinct values")


def run(
    df: DataFrame,
    definition: Definition,
    policy: GovernancePolicy = GovernancePolicy(),
    schema: EventSchema = EVENTS,
    limit: int | None = None,
) -> DataFrame:
    """Filtered, grouped, k-anonymous and ordered answer to a definition.

    All groups are given; with a ``limit`` the answer says how many there were (total_rows, truncated).

    Filters and the needed columns reach the scan; one shuffle on (dimensions, entity) feeds the
    distinct count, a second on the dimensions moves only partial results.
    """
    _check(definition, policy)
    conditions = [f.condition() for f in definition.filters]
    conditions.append(definition.time_range.condition(F.col(schema.date)))
    rows = df.filter(reduce(lambda a, b: a & b, conditions))
    dims = [
        grain(F.col(schema.date), d).alias(d) if d in GRAINS else F.col(d)
        for d in definition.dimensions
    ]
    measures = [m.expression(schema) for m in definition.measures]
    kept = k_anon(rows, dims, measures, schema.entity, policy.k)
    ordered = kept.orderBy(*definition.dimensions) if definition.dimensions else kept
    return cut(policy.check_columns(ordered), limit)
