"""Aggregate expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(column: str | Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows.

    A plain sum of doubles changes in its last bits with the partitioning, and
    amounts in fractions of a cent often sum to exactly half a cent, where
    those bits decide the rounding. So each value is summed as a decimal with
    ten places. Where a value does not fit (NaN, infinite, from 1e18) or the
    sum does not, the result is the plain sum.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    exact = value.try_cast("decimal(28,10)")
    summed = F.when(F.count(exact) == F.count(value), F.try_sum(exact).cast("double"))
    return F.coalesce(summed, F.sum(value))


def exact_avg(column: str | Column) -> Column:
    """Mean from the exact sum; null over no values."""
    return F.try_divide(exact_sum(column), F.count(column))


def total(column: str | Column) -> Column:
    """Sum, to two decimals."""
    return F.round(exact_sum(column), 2)


def average(column: str | Column) -> Column:
    """Mean, to two decimals."""
    return F.round(exact_avg(column), 2)


def margin_pct(profit: str = "profit", sales: str = "sales") -> Column:
    """Ratio of the sums in percent; null where sales sum to zero."""
    return F.round(F.try_divide(exact_sum(profit), exact_sum(sales)) * 100, 2)


def zero_filled_corr(a: str, b: str) -> Column:
    """Pearson correlation that counts a missing value as 0.0."""
    return F.corr(_zero(a), _zero(b))


def pairwise_corr(a: str, b: str) -> Column:
    """Pearson correlation over the rows where both values are known."""
    return F.corr(known(a), known(b))


def known(column: str) -> Column:
    """The value as a double, with NaN turned into null so that aggregates skip it."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))
