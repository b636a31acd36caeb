"""Similarity of embedding columns. All arithmetic is DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; NULL when either vector has length zero."""
    raw = F.try_divide(_dot(a, b), norm(a) * norm(b))
    # least and greatest skip NULL, so the clamp applies to known values only
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), raw)))


def score(distance: Column) -> Column:
    """Similarity score of a cosine distance, between 1/3 (opposite) and 1 (same direction)."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def mean_vector(vector: str, *keys: str):
    """Function from a DataFrame to its mean vector per key; each component rounded to 6 places.

    The mean is taken per position, so rows combine before the shuffle and only one list of
    ``dimension`` values per key is ever put together.
    """

    def apply(df):
        parts = df.select(*keys, F.posexplode(_double(F.col(vector))).alias("pos", "x"))
        means = parts.groupBy(*keys, "pos").agg(F.round(F.avg("x"), 6).alias("x"))
        ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
        return means.groupBy(*keys).agg(F.transform(ordered, lambda p: p["x"]).alias(vector))

    return apply
