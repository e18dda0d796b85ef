"""Arithmetic with floor modulo, half-even rounding, null-safe bounds and linear scales."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnOrName, as_col


def _num(x) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else as_col(x)


def divide(a, b) -> Column:
    """Quotient that is null, not an error, for a zero divisor."""
    return F.try_divide(_num(a), _num(b))


def floor_mod(a, b) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    a, b = _num(a), _num(b)
    return F.try_mod(F.try_mod(a, b) + b, b)


def floor_div(a, b) -> Column:
    """Quotient rounded towards minus infinity; null for a zero divisor."""
    return F.floor(divide(a, b))


def half_even(c: ColumnOrName, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def at_least(c: ColumnOrName, low) -> Column:
    """Elementwise maximum with a bound; null stays null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(c, _num(low)))


def at_most(c: ColumnOrName, high) -> Column:
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(c, _num(high)))


def clamp(c: ColumnOrName, low, high) -> Column:
    return at_most(at_least(c, low), high)


def linear_scale(c: ColumnOrName, domain: tuple, target: tuple) -> Column:
    """Map ``domain`` onto ``target`` linearly."""
    c, (d0, d1), (r0, r1) = as_col(c), map(_num, domain), map(_num, target)
    return r0 + divide(c - d0, d1 - d0) * (r1 - r0)


def sqrt_scale(c: ColumnOrName, domain: tuple, target: tuple) -> Column:
    """Map the square root of ``domain`` onto ``target`` linearly."""
    d0, d1 = map(_num, domain)
    return linear_scale(F.sqrt(as_col(c)), (F.sqrt(d0), F.sqrt(d1)), target)
