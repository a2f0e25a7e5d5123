"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def double(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("double")


def money(column: Column) -> Column:
    """An exact decimal sum as a DOUBLE with two decimals."""
    return double(F.round(column, 2))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, null when whole is zero."""
    return F.round(F.try_divide(F.lit(100.0) * double(part), double(whole)), digits)


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    value = F.try_divide(double(part), double(whole))
    return value if digits is None else F.round(value, digits)


def count_when(condition: Column) -> Column:
    """Rows where the condition holds (false and null do not count)."""
    return F.count_if(condition)


def share_of_total(column: str, digits: int = 2) -> Column:
    """Share of a group's value in the sum over all groups.

    Only for results already grouped by a bounded vocabulary (regions, modes, months):
    the window has no partition key.
    """
    return pct(F.col(column), F.sum(column).over(Window.partitionBy()), digits)


def year_month(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM")


def cv_from_sums(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation over mean, from count, sum and sum of squares.

    With integer measures the numerator is exact, so no rounding depends on row order; totals
    may reach 10^18. Null for fewer than two observations or a zero mean.
    """
    n, total, squares = (c.cast("decimal(38,0)") for c in (n, total, squares))
    spread = double(n * squares - total * total)
    variance = F.try_divide(spread, double(n) * (double(n) - 1))
    return F.try_divide(F.sqrt(variance), F.try_divide(double(total), double(n)))
