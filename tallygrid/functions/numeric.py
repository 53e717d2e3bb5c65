"""Numeric column expressions whose results do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """Round half away from zero after scaling by ``10**places``.

    Plain ``round`` on a double works on the printed decimal, so 1.005 gives 1.01;
    SQL engines that scale first give 1.0.  This is the second rule.
    """
    factor = F.lit(float(10**places))
    return F.round(value.cast("double") * factor) / factor


def mean(value: Column) -> Column:
    """Average as one division of a sum: exact if the column is decimal or integer."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def cents(value: Column) -> Column:
    """A money double as whole cents, so that sums are exact integer sums."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """``n / d`` where d is positive, else NULL."""
    return F.when(
        denominator > 0, F.try_divide(numerator.cast("double"), denominator.cast("double"))
    )


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def percent_change(before: Column, after: Column) -> Column:
    """``100 * (after - before) / before``; NULL where ``before`` is zero."""
    return F.try_divide(F.lit(100.0) * (after - before), before.cast("double"))


def first_argmax(values: Column) -> Column:
    """0-based index of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
