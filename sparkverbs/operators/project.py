"""Column selection, naming and bulk edits."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import fill


def starts_with(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def contains(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part.lower() in c.lower()]


def between(df: DataFrame, first: str, last: str) -> list[str]:
    cols = df.columns
    return cols[cols.index(first): cols.index(last) + 1]


def except_for(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The listed names that the table has; others are ignored."""
    return [n for n in names if n in df.columns]


def move_first(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, *except_for(df, *names))


def snake_case(name: str) -> str:
    """``Visitor Count (%)`` -> ``visitor_count_percent``, ``adminName`` -> ``admin_name``."""
    name = name.replace("%", "_percent_").replace("#", "_number_")
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    return f"x{name}" if not name or name[0].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    """Headers in snake case; repeated names are numbered."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = snake_case(c)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def rename(df: DataFrame, **new_to_old: str) -> DataFrame:
    return df.withColumnsRenamed({old: new for new, old in new_to_old.items()})


def mutate(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns one after the other, so later ones see earlier ones; Spark folds the projections into one."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def summarise_columns(df: DataFrame, f: Callable[[Column], Column], columns: Sequence[str], keys: Sequence[str] = ()):
    return df.groupBy(*keys).agg(*[f(F.col(c)).alias(c) for c in columns])


def scalar(df: DataFrame, aggregate: Column) -> Column:
    """An aggregate of a whole table as a value for use in other expressions (scalar subquery)."""
    return df.agg(aggregate.alias("v")).scalar()


def fill_missing(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace null and NaN by a constant in the listed (default: all numeric) columns."""
    types = dict(df.dtypes)
    numeric = [c for c, t in types.items() if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.withColumns({c: fill(c, value, types[c] in ("double", "float")) for c in (columns or numeric)})


def table_shape(df: DataFrame) -> DataFrame:
    """One row with the number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
