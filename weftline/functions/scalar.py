"""Expressions whose meaning differs from Spark's defaults: a division by zero is NULL, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def divide(left: Column | str | float, right: Column | str | float) -> Column:
    """``left / right``; NULL if the divisor is zero or either side is NULL."""
    return F.try_divide(_column(left), _column(right))


def int_divide(left: Column | str | int, right: Column | str | int) -> Column:
    """The quotient of whole numbers cut toward zero; NULL if the divisor is zero."""
    divisor = F.nullif(_column(right), F.lit(0))
    return F.call_function("div", _column(left), divisor)


def remainder(left: Column | str | float, right: Column | str | float) -> Column:
    """The rest with the dividend's sign; NULL if the divisor is zero."""
    return F.try_mod(_column(left), _column(right))


def choose(condition: Column, then: Column | float, otherwise: Column | float) -> Column:
    """``then`` where the condition is true, ``otherwise`` where it is false or NULL."""
    return F.when(condition, _column(then)).otherwise(_column(otherwise))


def average(x: Column | str) -> Column:
    """The mean of the values that aren't NULL, as a double; NULL without any."""
    return F.avg(_column(x).cast("double"))


def count_rows() -> Column:
    """``count(*)``."""
    return F.count(F.lit(1))
