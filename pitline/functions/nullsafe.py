"""Null-safe arithmetic. A missing value is always NULL: NaN and infinities never leave this module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def finite(value: Column) -> Column:
    """``value`` with NaN and ±infinity turned into NULL."""
    # NaN sorts above infinity, so one comparison covers both
    return F.when(F.abs(value) < F.lit(_INF), value)


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value) == F.lit(_INF), F.lit(False))


def safe_divide(num: Column, den: Column) -> Column:
    """``num / den``; NULL when either side is missing or infinite, the divisor is zero, or the result overflows."""
    return finite(F.try_divide(num.cast("double"), finite(den.cast("double"))))


def growth(current: Column, previous: Column) -> Column:
    """Relative change against the magnitude of the previous value."""
    return safe_divide(current - previous, F.abs(previous))


def first_present(*values: Column) -> Column:
    """First value that is neither NULL nor NaN, in the given order of preference."""
    return F.coalesce(*[F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in values])
