"""Numeric column expressions that give the same double in any IEEE engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**27 + 1)


def round_dp(x: Column, places: int) -> Column:
    """Round to ``places`` decimals by the exact binary value, ties to even.

    This is what ``printf`` and Python's ``round`` do (2.675 -> 2.67); Spark's
    ``round`` works on the shortest decimal text instead. ``x * 10^p`` is rounded
    once by the hardware; the exact remainder of that product (Dekker split) decides
    the cases that look like ties.
    """
    scale = F.lit(float(10**places))
    product = x * scale
    nearest = F.rint(product)
    big = x * F.lit(_SPLIT)
    high = big - (big - x)
    remainder = (high * scale - product) + (x - high) * scale
    looks_tied = (F.abs(product - nearest) == 0.5) & (remainder != 0.0)
    settled = F.when(
        looks_tied,
        F.when(remainder > 0, F.ceil(product)).otherwise(F.floor(product)).cast("double"),
    ).otherwise(nearest)
    return settled / scale + F.lit(0.0)  # no negative zero


def cents(amount: Column) -> Column:
    """Amount in integer hundredths, so that sums are exact in any order."""
    return F.floor(amount * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def mean_of_cents(total: Column, n: Column) -> Column:
    """Mean of integer cents as an amount, 2 places."""
    return round_dp(total.cast("double") / F.lit(100.0) / n.cast("double"), 2)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when the denominator is zero or null."""
    return F.coalesce(
        F.when(den != 0, num.cast("double") / den.cast("double")), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
