"""Exact order statistics of groups of any size, by histograms that narrow until a rank is one value.

Rows are first counted by (group, value). Every round counts the values between the bounds of each wanted rank in
equal parts, in the map tasks, and keeps the part that holds the rank; its bounds are values that occur. A group with
most of the rows gives a task no more than a few hundred counts, and no round moves values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.session import discard, written

#: Parts into which a round cuts the values between two bounds.
PARTS = 256


def _same_group(left: DataFrame, right: DataFrame, n: int) -> Column:
    same = F.lit(True)
    for i in range(n):
        same = same & left[f"g{i}"].eqNullSafe(right[f"h{i}"])
    return same


def with_group(rows: DataFrame, groups: DataFrame, dims: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` of their group; null is a group like any other."""
    named = groups.select(*[F.col(d).alias(f"group_{i}_") for i, d in enumerate(dims)], *columns)
    same = F.lit(True)
    for i, d in enumerate(dims):
        same = same & rows[d].eqNullSafe(named[f"group_{i}_"])
    return rows.join(named, same).drop(*[f"group_{i}_" for i in range(len(dims))])


def quantiles(df: DataFrame, value: Column, dims: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """dims and ``quantiles``: the exact, linearly interpolated quantiles of each group, in the order of ``shares``.

    Null, NaN and infinite values count for nothing; a group without others has no row. Runs one job a round, and
    as many rounds as it takes to tell neighbouring values apart: three or four for amounts.
    """
    columns = [F.col(d) for d in dims] or [F.lit(0)]
    n = len(columns)
    keys = [f"g{i}" for i in range(n)]
    plain = df.select(*[c.alias(k) for c, k in zip(columns, keys)], value.cast("double").alias("v"))
    plain = plain.where(F.abs("v") < float("inf")).withColumn("v", F.col("v") + F.lit(0.0))
    counts = written(plain.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = []
    for number, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("rows") - 1)
        for end in (F.floor(at), F.ceil(at)):
            wanted.append(F.struct(F.lit(number).alias("share"), end.alias("rank"), (at - F.floor(at)).alias("part")))
    bounds = whole.select(*[F.col(k).alias(f"h{i}") for i, k in enumerate(keys)], "low", "high", F.lit(0).cast("bigint").alias("below"), F.explode(F.array_distinct(F.array(*wanted))).alias("want"))
    open_ = written(bounds, "rank-bounds")
    found = open_.where("low = high")
    while not (open_ := open_.where("low < high")).isEmpty():
        open_ = written(_narrowed(counts, open_, n), "rank-bounds")
        found = found.unionByName(open_.where("low = high"))
    discard(counts)
    ends = found.groupBy(*[f"h{i}" for i in range(n)], "want.share").agg(
        F.min_by("low", "want.rank").alias("lower"), F.max_by("low", "want.rank").alias("upper"), F.first("want.part").alias("part")
    )
    between = (1 - F.col("part")) * F.col("lower") + F.col("part") * F.col("upper")
    listed = F.sort_array(F.collect_list(F.struct("share", between.alias("q"))))
    named = [F.col(f"h{i}").alias(d) for i, d in enumerate(dims)]
    return ends.groupBy(*[f"h{i}" for i in range(n)]).agg(listed.alias("q")).select(*named, F.transform("q", lambda x: x["q"]).alias("quantiles"))


def _narrowed(counts: DataFrame, bounds: DataFrame, n: int) -> DataFrame:
    """Bounds of the part of each range that holds the wanted rank."""
    groups = [f"h{i}" for i in range(n)]
    inside = counts.join(bounds, _same_group(counts, bounds, n) & counts["v"].between(bounds["low"], bounds["high"]))
    # Halves, so that the width of a range never overflows; where they are too small to differ, only the ends part.
    place = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
    place = F.coalesce(place, F.when(F.col("v") > F.col("low"), 1.0).otherwise(0.0))
    part = F.least(F.lit(PARTS - 1), F.floor(place * PARTS)).alias("bin")
    parts = inside.groupBy(*groups, "want", "below", part).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    order = Window.partitionBy(*groups, "want").orderBy("bin")
    upto = parts.withColumn("upto", F.col("below") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = upto.where("upto - n <= want.rank AND want.rank < upto")
    return chosen.select(*groups, "low", "high", (F.col("upto") - F.col("n")).alias("below"), "want")
