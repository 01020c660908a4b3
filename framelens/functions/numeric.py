"""Null-safe arithmetic on columns and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def positive(x: Column) -> Column:
    return finite(x) & F.coalesce(x > 0, F.lit(False))


def clamp01(x: Column) -> Column:
    """Into [0, 1]; what isn't finite becomes 0, a null stays null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.when(finite(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0))


def safe_div(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column, eps: float = 1e-8) -> Column:
    """The vector over its norm, which counts as ``eps`` at least and is evaluated once."""
    return F.zip_with(a, F.array_repeat(F.greatest(norm(a), F.lit(eps)), F.size(a)), lambda x, n: x / n)


def fit_within(dim: Column, longest: Column, limit: int) -> Column:
    """A side scaled so that the longest is ``limit`` at most: half-even rounding, 1 at least."""
    return F.when(longest > limit, F.greatest(F.lit(1), F.bround(dim * F.lit(float(limit)) / longest, 0).cast("int"))).otherwise(dim.cast("int"))


def crop_width(width: Column) -> Column:
    """A third of the width, cut to whole pixels, 1 at least."""
    return F.greatest(F.lit(1), F.floor(width * (1.0 / 3.0)).cast("int"))


def align_down(x: Column, multiple: int = 8) -> Column:
    return (F.floor(x / multiple) * multiple).cast("int")
