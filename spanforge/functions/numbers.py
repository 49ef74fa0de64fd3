"""Sums that neither overflow nor lose digits, and additions that stop at the largest long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 9_223_372_036_854_775_807
_SHIFT = 20
_UNIT = 1 << _SHIFT


def plus(value: Column, amount: int) -> Column:
    """``value + amount`` for a non-negative amount, at most the largest long."""
    return F.least(value, F.lit(MAX_LONG - amount)) + amount


def high(value: Column) -> Column:
    return F.shiftright(value, _SHIFT)


def low(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_UNIT - 1).cast("bigint"))


def joined(high_sum: Column, low_sum: Column) -> Column:
    """The total of two part sums as an exact decimal."""
    whole = high_sum.cast("decimal(28,0)") * F.lit(_UNIT).cast("decimal(8,0)")
    return whole + low_sum.cast("decimal(28,0)")


def exact_sum(value: Column) -> Column:
    """Sum of a bigint column that may exceed a bigint.

    High and low bits are added up apart, which stays within hash aggregation.
    """
    return joined(F.sum(high(value)), F.sum(low(value)))


def exact_mean(value: Column) -> Column:
    """Mean of a bigint column from its exact sum."""
    return exact_sum(value).cast("double") / F.count(value).cast("double")


def exact_mean_of_counted(value: Column, times: Column) -> Column:
    """As :func:`exact_mean` where every row stands for ``times`` rows."""
    total = joined(F.sum(high(value) * times), F.sum(low(value) * times))
    return total.cast("double") / F.sum(F.when(value.isNotNull(), times)).cast("double")
