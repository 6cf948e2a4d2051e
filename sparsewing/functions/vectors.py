"""Expressions on vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000


def quantise(x: Column, scale: int = SCALE) -> Column:
    """Array of floats to whole numbers, so that all later sums and ties are exact."""
    return F.transform(x, lambda v: F.round(v.cast("double") * F.lit(float(scale))).cast("bigint"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v)


def dtotal(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def centre(x: Column) -> Column:
    """d times (x - mean), which stays a whole number."""
    t, n = total(x), F.size(x).cast("bigint")
    return F.transform(x, lambda v: v * n - t)


def positive(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0).cast("bigint")))


def unit_mean(x: Column) -> Column:
    """x / mean(x); zeros where the mean is not above 0."""
    m = total(x).cast("double") / F.size(x)
    return F.transform(x, lambda v: F.when(m > 0, v / m).otherwise(F.lit(0.0)))


def norm2(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v * v)


def unit_norm(x: Column) -> Column:
    n = F.sqrt(norm2(x).cast("double"))
    return F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)))


def sqdist(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, v: a + v)


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y).cast("double") / (F.sqrt(norm2(x).cast("double")) * F.sqrt(norm2(y).cast("double")))


def angle(x: Column, y: Column) -> Column:
    """Degrees between two vectors from the chord of their unit vectors, which keeps small angles exact."""
    chord = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * cosine(x, y)))
    return F.degrees(F.lit(2.0) * F.asin(F.least(F.lit(1.0), chord / 2)))


def type_to_dim(t: Column) -> Column:
    """Name before the first underscore; null for null, ``M_...`` and ``CB...``."""
    return F.when(t.isNull() | t.startswith("M_") | t.startswith("CB"), F.lit(None).cast("string")).otherwise(F.split_part(t, F.lit("_"), F.lit(1)))
