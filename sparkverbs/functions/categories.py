"""Categories are plain text columns with an ordinal column beside them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnOrName, as_col, in_set


def level_ordinal(c: ColumnOrName, levels: list) -> Column:
    """1-based position of the value in ``levels``; values not listed give null."""
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.when(at > 0, at).cast("int")


def known_level(c: ColumnOrName, levels: list) -> Column:
    """The value itself, null if it is not one of ``levels``."""
    return F.when(in_set(c, levels), as_col(c))


def relevel(levels: list, *front) -> list:
    """Level list with ``front`` moved to the start, the rest in their old order."""
    return [*front, *[v for v in levels if v not in front]]


def recode(c: ColumnOrName, mapping: dict) -> Column:
    """Rename levels; values not listed stay as they are."""
    c = as_col(c)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[c], c)


def other(c: ColumnOrName, keep: list, other_level: str = "Other") -> Column:
    """Keep the listed levels, name the rest ``other_level``; null stays null."""
    c = as_col(c)
    return F.when(in_set(c, keep), c).when(c.isNotNull(), F.lit(other_level))


def interaction(*cols: ColumnOrName, sep: str = ".") -> Column:
    """One category from several; null if any part is null."""
    parts = [x for c in cols for x in (F.lit(sep), as_col(c).cast("string"))][1:]
    return F.concat(*parts)


def cut(c: ColumnOrName, breaks: list, labels: list[str] | None = None) -> Column:
    """Bin of a number by intervals open on the left and closed on the right; outside is null."""
    c, chain = as_col(c), F
    labels = labels or [f"({lo},{hi}]" for lo, hi in zip(breaks, breaks[1:])]
    for lo, hi, label in zip(breaks, breaks[1:], labels):
        chain = chain.when((c > lo) & (c <= hi), F.lit(label))
    return chain
