"""Date and time functions on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnOrName, as_col

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def parse_timestamp(c: ColumnOrName, fmt: str) -> Column:
    """Zone-free timestamp from text; text that does not fit the format gives null."""
    c = as_col(c)
    fits = F.try_to_timestamp(c, F.lit(fmt)).isNotNull()
    return F.when(fits, F.to_timestamp_ntz(c, F.lit(fmt)))


def parse_date(c: ColumnOrName, fmt: str) -> Column:
    return F.try_to_timestamp(as_col(c), F.lit(fmt)).cast("date")


def weekday_index(c: ColumnOrName) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(as_col(c))


def weekday_label(c: ColumnOrName) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(as_col(c)) + 1)


def year_diff(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return F.year(as_col(later)) - F.year(as_col(earlier))
