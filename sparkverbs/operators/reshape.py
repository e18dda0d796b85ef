"""Union, unpivot, pivot, splitting cells and filling sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import CELL_SEPARATOR, cells, words
from .levels import list_levels


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_tagged(tables: dict[object, DataFrame], name: str = "id") -> DataFrame:
    """Stack tables and say in a column which one a row came from."""
    return union_by_name(*[t.withColumn(name, F.lit(tag)) for tag, t in tables.items()])


def longer(df: DataFrame, columns: Sequence[str], names_to: str = "name", values_to: str = "value", prefix: str = ""):
    """Wide to long; ``prefix`` is cut off the names. One pass, no shuffle."""
    keep = [c for c in df.columns if c not in columns]
    out = df.unpivot(keep, list(columns), names_to, values_to)
    if prefix:
        out = out.withColumn(names_to, F.regexp_replace(names_to, f"^{prefix}", ""))
    return out


def longer_by_pattern(df: DataFrame, columns: Sequence[str], names_to: Sequence[str], pattern: str, values_to: str = "value"):
    """Wide to long; the name is split into several keys by the groups of a pattern."""
    out = longer(df, columns, "__name", values_to)
    keys = {n: F.regexp_extract("__name", pattern, i + 1) for i, n in enumerate(names_to)}
    return out.withColumns(keys).drop("__name")


def longer_sets(df: DataFrame, sets: dict[object, dict[str, str]], names_to: str = "set") -> DataFrame:
    """Wide to long with several value columns: ``{set: {value column: source column}}``."""
    used = {src for s in sets.values() for src in s.values()}
    keep = [c for c in df.columns if c not in used]
    fields = list(next(iter(sets.values())))
    rows = F.array(*[F.struct(F.lit(tag).alias(names_to), *[F.col(s[f]).alias(f) for f in fields]) for tag, s in sets.items()])
    return df.select(*keep, F.inline(rows))


def wider(df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence | None, values_from: str, fill=None,
          aggregate: Callable[[Column], Column] = F.first, others: str = "error") -> DataFrame:
    """Long to wide. ``names`` fixes the columns and saves a job; ``None`` takes all names that occur.

    A row with a name that isn't listed stops the query with an error, unless ``others="drop"`` says that it is not wanted. A null
    name counts as one that isn't listed (``None`` passes it over).
    """
    df, names = _named(df, names_from, names, others)
    out = df.groupBy(*keys).pivot(names_from, names).agg(aggregate(F.col(values_from)))
    return out if fill is None else out.na.fill(fill, subset=[str(n) for n in names])


def _named(df: DataFrame, names_from: str, names: Sequence | None, others: str) -> tuple[DataFrame, list]:
    if names is None:
        return df.where(F.col(names_from).isNotNull()), list_levels(df, names_from)
    if others not in ("error", "drop"):
        raise ValueError("others is 'error' or 'drop'")
    listed = F.col(names_from).isin(list(names))
    if others == "drop":
        return df.where(listed), list(names)
    what = F.concat(F.lit(f"{names_from} has a value that is not listed: "), F.coalesce(F.col(names_from).cast("string"), F.lit("null")))
    kind = df.schema[names_from].dataType
    return df.withColumn(names_from, F.when(listed, F.col(names_from)).otherwise(F.raise_error(what).cast(kind))), list(names)


def wider_multi(df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence | None, values_from: Sequence[str],
                others: str = "error") -> DataFrame:
    """Long to wide with several value columns, named ``<value>_<name>``; names as in ``wider``."""
    df, names = _named(df, names_from, names, others)
    one = F.struct(*[F.col(v) for v in values_from])
    out = df.groupBy(*keys).pivot(names_from, names).agg(F.first(one))
    return out.select(*keys, *[F.col(f"`{n}`")[v].alias(f"{v}_{n}") for n in names for v in values_from])


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, names: Sequence | None, values: str, fill=0,
                aggregate: Callable[[Column], Column] = F.avg, others: str = "error") -> DataFrame:
    """Pivot with the mean by default; null keys are dropped and empty cells filled; names as in ``wider``."""
    present = df.na.drop(subset=[*index, columns])
    return wider(present, index, columns, names, values, fill, aggregate, others)


def split_rows(df: DataFrame, column: str, separator: str = CELL_SEPARATOR) -> DataFrame:
    """One row per piece of a delimited cell."""
    return df.withColumn(column, F.explode(cells(column, separator)))


def tokens(df: DataFrame, text: str, name: str = "word") -> DataFrame:
    """One row per word of a text, in place of the text."""
    return df.withColumn(name, F.explode(words(text))).drop(*([text] if text != name else []))


def fill_sequence(df: DataFrame, keys: Sequence[str], step: str, first: Column, last: Column) -> DataFrame:
    """Complete the integer sequence ``step`` per group from ``first`` to ``last`` (aggregates of the group).

    Positions without a row get one with nulls.
    """
    span = df.groupBy(*keys).agg(first.alias("__a"), last.alias("__b"))
    frame = span.select(*keys, F.explode(F.sequence("__a", "__b")).alias(step))
    return frame.join(df, [*keys, step], "left")
