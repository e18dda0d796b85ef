"""Joins with null-matching keys, clashing names, code lookups and range expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import ColumnOrName, as_col


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str | tuple[str, str]],
    how: str = "inner",
    null_safe: bool = False,
    suffixes: tuple[str, str] = (".x", ".y"),
) -> DataFrame:
    """Equi-join; a key is one name or a pair (left name, right name), the right key is dropped.

    ``null_safe`` lets null match null. Other columns of the same name get the suffixes.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in keys]
    if how not in ("left_semi", "left_anti"):
        clash = (set(left.columns) - {a for a, _ in pairs}) & (set(right.columns) - {b for _, b in pairs})
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    hidden = {b: f"__key{i}" for i, (_, b) in enumerate(pairs)}
    right = right.withColumnsRenamed(hidden)
    on = None
    for a, b in pairs:
        match = left[f"`{a}`"].eqNullSafe(F.col(hidden[b])) if null_safe else left[f"`{a}`"] == F.col(hidden[b])
        on = match if on is None else on & match
    joined = left.join(right, on, how)
    if how in ("right", "full"):
        joined = joined.withColumns({a: F.coalesce(F.col(f"`{a}`"), F.col(hidden[b])) for a, b in pairs})
    return joined.drop(*hidden.values())


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both tables have."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return join_on(left, right, shared, how)


def rows_in(df: DataFrame, column: str, other: DataFrame, other_column: str | None = None) -> DataFrame:
    """Rows whose value occurs in a column of another table."""
    return join_on(df, other.select(other_column or column), [(column, other_column or column)], "left_semi", null_safe=True)


def rows_not_in(df: DataFrame, column: str, other: DataFrame, other_column: str | None = None) -> DataFrame:
    """Rows whose value does not occur in a column of another table; rows with a null value stay unless null occurs."""
    return join_on(df, other.select(other_column or column), [(column, other_column or column)], "left_anti", null_safe=True)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that are not in ``right``, compared on the shared columns; null equals null."""
    shared = [c for c in left.columns if c in right.columns]
    return join_on(left, right.select(*shared), shared, "left_anti", null_safe=True)


def crossing(df: DataFrame, column: str, values: Sequence, name: str | None = None) -> DataFrame:
    """All combinations of the distinct values of ``column`` with a literal list; the list is part of the plan."""
    return df.select(column).distinct().withColumn(name or "value", F.explode(F.array(*[F.lit(v) for v in values])))


def expand_until(df: DataFrame, start: ColumnOrName, first: int, last: int, name: str = "until") -> DataFrame:
    """Cumulative expansion: a row of period v appears in every period from max(v, first) to last.

    Rows before ``first`` are left out, so the series starts empty. One scan, no join.
    """
    v = as_col(start)
    return df.where((v >= first) & (v <= last)).withColumn(name, F.explode(F.sequence(v.cast("int"), F.lit(last))))


def code_lookup(df: DataFrame, code: str, table: DataFrame, table_code: str, table_value: str, name: str,
                fallback: Column | None = None) -> DataFrame:
    """Value of a code from a lookup table, or ``fallback`` (the code itself if not given)."""
    hit = table.select(F.col(table_code).alias("__code"), F.col(table_value).alias("__value"))
    joined = df.join(hit, df[code] == hit["__code"], "left")
    default = as_col(code) if fallback is None else fallback
    return joined.withColumn(name, F.coalesce("__value", default)).drop("__code", "__value")


def literal_lookup(c: ColumnOrName, table: dict, fallback: Column | None = None) -> Column:
    """Value of a code from a small literal table."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(mapping[as_col(c)], as_col(c) if fallback is None else fallback)


def repair(target: ColumnOrName, replacement: Column) -> Column:
    """Fill a missing key from another expression."""
    return F.coalesce(as_col(target), replacement)
