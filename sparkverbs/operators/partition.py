"""Nested share partition (marimekko) of a total by three ordered keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .ordered import ordered_scan
from .windows import with_group_stats


def marimekko(df: DataFrame, keys: list[tuple[str, str]], value: str, bounded: bool = True) -> DataFrame:
    """Rectangles of the unit square, one per combination of three keys.

    keys   three pairs (key column, column with its position in the level order)
    value  measure to add up
    Level i splits each band of level i-1 by share, in level order: columns pct_i, min_i, max_i and the rectangle
    xmin, xmax, ymin, ymax. A share of an empty parent is 0. ``bounded`` says that the distinct key combinations
    are few (they are drawn); the bands then come from plain windows over the aggregated table.
    """
    names = [k for k, _ in keys]
    # every level reads the aggregated table
    base = materialise(df.groupBy(*[c for pair in keys for c in pair]).agg(F.sum(value).alias("total")))
    out = base
    for i in range(1, len(keys) + 1):
        parent, here, order = names[: i - 1], names[:i], keys[i - 1][1]
        level = base.groupBy(*here, order).agg(F.sum("total").alias("__t"))
        level = with_group_stats(level, parent, base, __parent=F.sum("total"))
        level = level.withColumn(f"pct_{i}", F.coalesce(F.try_divide(F.col("__t"), F.col("__parent")), F.lit(0.0)))
        level = ordered_scan(level, [order], parent, running={f"max_{i}": f"pct_{i}"}, bounded=bounded)
        level = level.withColumn(f"min_{i}", F.col(f"max_{i}") - F.col(f"pct_{i}"))
        out = out.join(level.select(*here, f"pct_{i}", f"min_{i}", f"max_{i}"), here)
    height = F.col("max_1") - F.col("min_1")
    return (out.withColumns({"xmin": F.col("min_2"), "xmax": F.col("max_2")})
            .withColumns({"ymin": F.col("min_1") + height * F.col("min_3"),
                          "ymax": F.col("min_1") + height * F.col("max_3")}))


def band_labels(rectangles: DataFrame, key: str) -> DataFrame:
    """Middle of each first-level band, one row per level."""
    middle = (F.col("max_1") - F.col("min_1")) / 2 + F.col("min_1")
    return rectangles.select(key, middle.alias("ylabel")).distinct()
