"""Cleaning and return expressions on single columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nan_to_null(c: Column) -> Column:
    """Missing is NULL everywhere: ``last(ignorenulls)`` would not skip a NaN."""
    return F.when(~F.isnan(c), c)


def fill_zero(c: Column) -> Column:
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def guard_infinity(c: Column, to: float = 0.0) -> Column:
    return F.when(F.abs(c) == F.lit(INF), F.lit(to)).otherwise(c)


def growth(now: Column, before: Column) -> Column:
    """now / before - 1; NULL when either side is missing or before is zero."""
    return F.try_divide(now, before) - 1.0


def left_zero(now: Column, before: Column) -> Column:
    """True where the return is infinite: a nonzero price after a zero price."""
    return F.coalesce((before == 0.0) & (now != 0.0), F.lit(False))


def input_return(now: Column, before: Column) -> Column:
    """Return of an input column: infinite returns become 0, missing ones stay missing."""
    return F.when(left_zero(now, before), F.lit(0.0)).otherwise(growth(now, before))


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero: the form results are compared in."""
    return F.round(c, 6) + F.lit(0.0)


def whole_day(c: Column) -> Column:
    """Date of a string, timestamp or date column; time of day is dropped."""
    return F.to_date(c)
