"""k-anonymous aggregation, suppression reports, roll-up on violation, audits of finished results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES = "entities"

#: How partial results of a measure combine when groups are merged.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def k_anon(
    df: DataFrame,
    dims: Sequence[Column | str],
    aggs: Sequence[Column],
    entity: str,
    k: int,
    keep_entities: bool = False,
) -> DataFrame:
    """Aggregate and keep only groups with at least ``k`` distinct entities.

    The distinct count is planned as two shuffles: rows are first combined per (group, entity), so a
    group holding a third of the table is spread over all tasks; only one partial row per map task
    and group reaches the second shuffle.
    """
    grouped = df.groupBy(*dims).agg(*aggs, F.countDistinct(entity).alias(ENTITIES))
    kept = grouped.filter(F.col(ENTITIES) >= k)
    return kept if keep_entities else kept.drop(ENTITIES)


def k_anon_report(
    df: DataFrame, dims: Sequence[Column | str], entity: str, k: int
) -> DataFrame:
    """One row: groups and rows that a threshold keeps and those it hides."""
    groups = df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias(ENTITIES)
    )
    shown = F.col(ENTITIES) >= k
    rows = F.col("n_rows")
    return groups.agg(
        F.count_if(shown).alias("kept_groups"),
        F.count_if(~shown).alias("suppressed_groups"),
        F.coalesce(F.sum(F.when(shown, rows)), F.lit(0)).alias("kept_rows"),
        F.coalesce(F.sum(F.when(~shown, rows)), F.lit(0)).alias("suppressed_rows"),
    )


def k_anon_rollup(
    df: DataFrame,
    dims: Sequence[str],
    measures: Mapping[str, tuple[str, str]],
    entity: str,
    k: int,
) -> DataFrame:
    """Report every part of the data at the finest level that is safe to show.

    A node of the roll-up is split into its children only when all of them reach ``k``; otherwise the
    node itself is shown. No sibling of a hidden group is ever published next to its parent, so a
    hidden group cannot be found by subtraction. ``measures`` maps an alias to (function, column)
    with a mergeable function: sum, count, min or max.

    Rows are combined per (dims, entity) before the roll-up expands them, so the expansion works on
    one row per entity and group instead of on raw rows.
    """
    partial = [_PARTIAL[fn](column).alias(name) for name, (fn, column) in measures.items()]
    merged = [_MERGE[fn](name).alias(name) for name, (fn, _) in measures.items()]
    depth = len(dims)
    per_entity = df.groupBy(*dims, entity).agg(*partial)
    nodes = (
        per_entity.rollup(*dims)
        .agg(F.grouping_id().alias("gid"), F.countDistinct(entity).alias(ENTITIES), *merged)
        # the grouping id of a roll-up has one low bit set per dimension that was rolled up
        .withColumn("level", F.lit(depth) - F.bit_count("gid"))
        .drop("gid")
    )
    level = F.col("level")
    # a scan of two columns is cheaper here than a second roll-up
    widest = df.groupBy(dims[0]).agg(F.countDistinct(entity).alias(ENTITIES))
    top = widest.agg(F.min(ENTITIES)).scalar()
    # split_<m>: fewest entities among the children at level m of a node's ancestor at level m - 1
    splits = [top.alias("split_1")]
    for m in range(2, depth + 1):
        prefix = [F.when(level >= m - 1, F.col(d)) for d in dims[: m - 1]]
        siblings = Window.partitionBy((level >= m - 1), *prefix)
        splits.append(F.min(F.when(level == m, F.col(ENTITIES))).over(siblings).alias(f"split_{m}"))
    judged = nodes.select("*", *splits)
    reached = reduce(
        lambda a, b: a & b,
        [(level < m) | (F.col(f"split_{m}") >= k) for m in range(1, depth + 1)],
    )
    splittable = reduce(
        lambda a, b: a | b,
        [(level == m - 1) & (F.col(f"split_{m}") >= k) for m in range(1, depth + 1)],
    )
    shown = judged.filter(reached & ~F.coalesce(splittable, F.lit(False)) & (F.col(ENTITIES) >= k))
    return shown.select("level", *dims, *measures, ENTITIES)


def is_count_like(column: str) -> bool:
    """Default rule for count columns: the name contains 'count' or 'unique'.

    It also matches names such as ``discount`` or ``account_type``; callers with such columns pass an
    explicit list instead.
    """
    return "count" in column.lower() or "unique" in column.lower()


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    wanted = set(columns)
    return [
        f.name
        for f in df.schema.fields
        if f.name in wanted and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def audit(result: DataFrame, k: int, count_columns: Sequence[str] | None = None) -> DataFrame:
    """Every cell of a finished result whose count is below ``k``, with the row's dimensions as JSON."""
    counts = list(count_columns or [c for c in result.columns if is_count_like(c)])
    others = [c for c in result.columns if c not in counts]
    dims = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("count"))
        for c in _numeric(result, counts)
    ]
    if not cells:
        schema = "column string, count double, dimensions string"
        return result.sparkSession.createDataFrame([], schema)
    return (
        result.select(F.inline(F.array(*cells)), dims.alias("dimensions"))
        .filter(F.col("count") < k)
        .select("column", "count", "dimensions")
    )


def entity_distribution(
    df: DataFrame, entity: str, amount: str, edges: Sequence[float], k: int
) -> DataFrame:
    """Safe form of 'top customers': how many entities have a total in each bucket.

    Identifiers stay inside the first aggregation; buckets with fewer than ``k`` entities are hidden.
    """
    totals = df.groupBy(entity).agg(F.sum(amount).alias("total"))
    bucket = F.lit(0)
    for edge in edges:
        bucket = bucket + F.when(F.col("total") >= F.lit(edge), 1).otherwise(0)
    return (
        totals.filter(F.col("total").isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias(ENTITIES), F.sum("total").alias("total"))
        .filter(F.col(ENTITIES) >= k)
    )


def single_entity_groups(df: DataFrame, dims: Sequence[Column | str], entity: str) -> DataFrame:
    """How many groups rest on one entity only, out of all groups."""
    groups = df.groupBy(*dims).agg(F.countDistinct(entity).alias(ENTITIES))
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col(ENTITIES) == 1).alias("single_entity_groups"),
    )
