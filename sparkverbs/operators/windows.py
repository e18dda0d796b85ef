"""Group statistics on every row, top rows with ties, scaling, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import divide
from .joins import join_on
from .ordered import ordered_scan


def with_group_stats(df: DataFrame, keys: Sequence[str], source: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of the group on each row.

    The aggregate is combined before its shuffle and joined back, so a group of any size is spread over
    tasks; a small result is broadcast by the measured size. Without keys the values come from a scalar subquery.
    The input is evaluated twice; materialise it first if it is expensive.
    ``source`` names the table to aggregate if it is not ``df``: for several statistics of one table in a row, so
    that the later ones do not repeat the joins of the earlier ones.
    """
    names, source = list(aggregates), df if source is None else source
    if not keys:
        one = source.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("s")).scalar()
        return df.withColumns({n: one[n] for n in names})
    stats = source.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    kept = df.drop(*[n for n in names if n in df.columns])
    return join_on(kept, stats, keys, "inner", null_safe=True)


def share_of(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "share", total: Column | None = None):
    """Value divided by the sum (or another aggregate) of its group; null for a zero total."""
    stats = with_group_stats(df, keys, __total=F.sum(value) if total is None else total)
    return stats.withColumn(name, divide(F.col(value), F.col("__total"))).drop("__total")


def scale_max(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "scaled") -> DataFrame:
    return share_of(df, value, keys, name, total=F.max(value))


def rescale01(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns mapped to 0..1 by their minimum and maximum over all rows."""
    one = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).alias("s")).scalar()
    return df.withColumns({c: divide(F.col(c) - one[c]["lo"], one[c]["hi"] - one[c]["lo"]) for c in columns})


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Columns standardised with the population deviation over all rows."""
    one = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("d")).alias(c) for c in columns]).alias("s")).scalar()
    return df.withColumns({c + suffix: divide(F.col(c) - one[c]["m"], one[c]["d"]) for c in columns})


def top_n(df: DataFrame, n: int, weight: str, keys: Sequence[str] = (), bottom: bool = False) -> DataFrame:
    """Rows whose weight is among the ``n`` largest (smallest) of the group; all ties stay, null weights do not.

    Works on counted distinct weights to find the weight of the n-th row, then filters the rows. No task
    sees more than n weights of a group from each partition, however many rows share a weight.
    """
    present = df.where(F.col(weight).isNotNull())
    order = F.col(weight).asc() if bottom else F.col(weight).desc()
    counts = present.groupBy(*keys, weight).agg(F.count(F.lit(1)).alias("__same"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    if keys:
        leading = counts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    else:
        leading = counts.orderBy(order).limit(n)
    before = F.coalesce(F.sum("__same").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = leading.withColumn("__before", before).where(F.col("__before") < n)
    edge = F.max(weight) if bottom else F.min(weight)
    if keys:
        edges = kept.groupBy(*keys).agg(edge.alias("__edge"))
        rows = join_on(present, edges, keys, "inner", null_safe=True)
    else:
        rows = present.withColumn("__edge", kept.agg(edge.alias("e")).scalar())
    test = F.col(weight) <= F.col("__edge") if bottom else F.col(weight) >= F.col("__edge")
    return rows.where(test).drop("__edge")


def first_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence, n: int = 1) -> DataFrame:
    """First ``n`` rows per key in a stated order, all columns. Each task passes on at most n rows of a key."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def mark_first(df: DataFrame, keys: Sequence[str], order_by: Sequence, name: str = "main", bounded: bool = False) -> DataFrame:
    """Flag the first row of each group in a stated order."""
    marked = ordered_scan(df, order_by, keys, row_number="__rn", bounded=bounded)
    return marked.withColumn(name, F.col("__rn") == 1).drop("__rn")


def bands(
    df: DataFrame,
    size: str,
    order_by: Sequence,
    keys: Sequence[str] = (),
    gap_when: str | None = None,
    gap: float = 0,
    start: str = "start",
    end: str = "end",
    bounded: bool = False,
) -> DataFrame:
    """Consecutive intervals ``[start, end)`` whose lengths are ``size``, in order, per group.

    With ``gap_when`` a gap is left wherever that column differs from the row before.
    """
    if gap_when is None:
        out = ordered_scan(df, order_by, keys, running={end: size}, bounded=bounded)
        return out.withColumn(start, F.col(end) - F.col(size))
    flagged = ordered_scan(df, order_by, keys, previous={"__prev": (gap_when, None)}, row_number="__rn", bounded=bounded)
    changed = (F.col("__rn") > 1) & ~F.col(gap_when).eqNullSafe(F.col("__prev"))
    flagged = flagged.withColumn("__gap", F.when(changed, gap).otherwise(gap * 0))
    out = ordered_scan(flagged, order_by, keys, running={end: F.col(size) + F.col("__gap")}, bounded=bounded)
    return out.withColumn(start, F.col(end) - F.col(size)).drop("__prev", "__rn", "__gap")


def midpoints(df: DataFrame, keys: Sequence[str], start: str = "start", size: str = "size", name: str = "midpoint"):
    """Middle of the stretch that a group covers, on each row."""
    return with_group_stats(df, keys, **{name: F.min(start) + F.sum(size) / 2})
