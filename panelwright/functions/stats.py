"""Statistics as column expressions, with pandas' conventions for missing and constant data."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Windows of a long panel: one asset through time, one cross-section.
ASSET = ("factor", "asset")
DATE = ("factor", "date")


def over(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: Column | None, high: Column | None) -> Column:
    """x within bounds; a null x stays null and a null bound does not clip."""
    out = x
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(x.isNotNull(), out)


def quantile(x: Column, q: float) -> Column:
    return F.percentile(x, F.lit(q))


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness: null below three values, 0 for a constant."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.coalesce(null_if_nan(F.skewness(x)) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: null below four values, 0 for a constant."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * null_if_nan(F.kurtosis(x)) + 6), F.lit(0.0)))


def tidy(x: Column, digits: int = 6) -> Column:
    """A rounded double without negative zero, for comparing engines.

    The small shift keeps exact ties (means of few decimals are often ones) from going either way.
    """
    return F.round(x + F.lit(1e-9), digits) + F.lit(0.0)


def average_rank(value: Column, *keys: str) -> Column:
    """Rank among a partition's non-null values, ties at their average rank."""
    held = value.isNotNull()
    w = Window.partitionBy(*keys, held)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, held, value))
    return F.when(held, F.rank().over(w.orderBy(value)) + (ties - 1) / 2)
