"""Category levels that depend on data: order, lumping, order taken from another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .aggregates import count_by, exact_quantiles
from .joins import join_on
from .ordered import number_rows
from .windows import top_n

MAX_LEVELS = 10_000  # the same bound that Spark sets for pivot columns


def list_levels(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct values as a Python list; refuses a column with more than ``max_levels`` values."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in found)


def median_order(df: DataFrame, level: str, measure: str, descending: bool = False, weight: str | None = None) -> DataFrame:
    """Table (level, median, ordinal) with levels in the order of their median; ties by name."""
    medians = exact_quantiles(df, measure, {"median": 0.5}, [level], weight)
    by = F.col("median").desc_nulls_last() if descending else F.col("median").asc_nulls_last()
    return number_rows(medians, [by, level], name=f"{level}_ord")


def reorder_by_median(df: DataFrame, level: str, measure: str, descending: bool = False) -> DataFrame:
    """Add ``<level>_ord``."""
    return with_level_order(df, level, median_order(df, level, measure, descending))


def with_level_order(df: DataFrame, level: str, order: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Add the ordinal that another table gives to each level; unknown levels get null."""
    ordinal = ordinal or f"{level}_ord"
    return join_on(df, order.select(level, ordinal), [level], "left")


def order_from(table: DataFrame, level: str, order_by: list, bounded: bool = False) -> DataFrame:
    """Table (level, ordinal) from the sort order of a table with one row per level."""
    return number_rows(table, [*order_by, level], name=f"{level}_ord", bounded=bounded).select(level, f"{level}_ord")


def lump(df: DataFrame, column: str, n: int, other_level: str = "Other", counts: DataFrame | None = None) -> DataFrame:
    """Keep the ``n`` most frequent levels (more if tied) and rename the rest.

    ``counts`` (column, n) saves a pass over ``df`` where the frequencies are known already.
    """
    counts = count_by(df, column) if counts is None else counts
    kept = top_n(counts.where(F.col(column).isNotNull()).select(column, F.col("n").alias("__n")), n, "__n")
    flagged = join_on(df, kept.select(column, F.lit(True).alias("__kept")), [column], "left")
    value = F.when(F.col(column).isNull() | F.col("__kept"), F.col(column)).otherwise(F.lit(other_level))
    return flagged.withColumn(column, value).drop("__kept")
