"""Counts, exact quantiles and grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..session import materialise
from .joins import join_on


def count_by(df: DataFrame, *keys: str, weight: str | None = None, name: str = "n", sort: bool = False, drop_null: bool = False):
    """Rows (or summed weight) per group; sorted by count descending with ties in key order."""
    if drop_null:
        df = df.na.drop(subset=list(keys))
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    out = df.groupBy(*keys).agg(amount.alias(name))
    return out.orderBy(F.col(name).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]) if sort else out


def top_counts(df: DataFrame, n: int, *keys: str, weight: str | None = None, name: str = "n") -> DataFrame:
    """The ``n`` groups with the largest count; ties at the cut are decided by key order."""
    return count_by(df, *keys, weight=weight, name=name).orderBy(
        F.col(name).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def first_by(value: str, order_by: str) -> Column:
    """Value of the first row of the group in the given order."""
    return F.min_by(value, order_by)


def ratio_when(value: str, test: Column) -> Column:
    """Share of the summed value that falls under a condition."""
    return F.try_divide(F.sum(F.when(test, F.col(value)).otherwise(F.lit(0))), F.sum(value))


#: Buckets of a round of narrowing, and rows that may be left in a bucket for the last step.
BUCKETS, FEW = 4096, 20_000
LOW, HIGH = "__low", "__high"


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, per group.

    Selection by narrowing: each round counts the values of a range in ``BUCKETS`` buckets and goes on with the smallest and
    largest value of the bucket that holds the wanted rank, until few rows are left there. Nothing is sorted and no row is
    moved: counts are added up before their shuffle, so neither a hot group nor ties end up in one task. NaN comes last.
    ``weight`` names a column that says how many times a row counts.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    times = F.lit(1) if weight is None else F.col(weight)
    rows = df.where(F.col(value).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("__v"), times.cast("bigint").alias("__n"))
    finite = F.when(~F.isnan("__v") & (F.abs("__v") != float("inf")), F.col("__v"))
    ends = with_range(rows, rows.groupBy(*names).agg(F.min(finite).alias(LOW), F.max(finite).alias(HIGH)), names)
    counted = materialise(_buckets(ends, names))

    own = Window.partitionBy(*(names or [F.lit(0)]))  # at most BUCKETS + 3 rows
    placed = counted.withColumn("__total", F.sum("__c").over(own))
    places = [(F.col("__total") - 1) * F.lit(float(p)) for p in probs.values()]
    wanted = [F.struct(F.lit(2 * i + j).alias("t"), f(at).alias("rank")) for i, at in enumerate(places) for j, f in enumerate((F.floor, F.ceil))]
    placed = placed.withColumn("__before", _before(own.orderBy("__b"))).withColumn("__w", F.explode(F.array(*wanted)))
    found = _holding(placed, F.col("__w.rank"), [*names, F.col("__w.t").alias("__t"), "__total"])
    while True:
        open_ = (F.col(LOW) < F.col(HIGH)) & (F.col("__c") > FEW)
        seen = Observation()
        found = materialise(found.observe(seen, F.count(F.when(open_, 1)).alias("n")))
        if seen.get["n"] == 0:
            break
        wide = found.where(open_)
        ranges = [*names, LOW, HIGH]
        inner = _buckets(_in_ranges(rows, wide, names), ranges, "__in_low", "__in_high")
        inner = inner.withColumn("__before", _before(Window.partitionBy(*ranges).orderBy("__b")))
        both = join_on(wide.withColumnRenamed("__c", "__outer"), inner, ranges, null_safe=True).drop(LOW, HIGH)
        both = both.withColumnsRenamed({"__in_low": LOW, "__in_high": HIGH})
        found = found.where(~open_).unionByName(_holding(both, F.col("__rank"), [*names, "__t", "__total"]))

    last = found.where(F.col(LOW) < F.col(HIGH))
    ranges = [*names, LOW, HIGH]
    values = _in_ranges(rows, last, names).groupBy(*ranges, "__v").agg(F.sum("__n").alias("__c"))
    values = values.withColumn("__before", _before(Window.partitionBy(*ranges).orderBy("__v"))).withColumnRenamed("__c", "__times")
    hit = (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__times"))
    picked = join_on(last, values, ranges, null_safe=True).where(hit).select(*names, "__t", "__total", "__v")
    picked = picked.unionByName(found.where(~(F.col(LOW) < F.col(HIGH))).select(*names, "__t", "__total", F.col(LOW).alias("__v")))
    picked = picked.groupBy(*names).agg(F.max("__total").alias("__total"), *[
        F.max(F.when(F.col("__t") == i, F.col("__v"))).alias(f"__s{i}") for i in range(2 * len(probs))])
    if not names:
        picked = picked.where("__total is not null")
    ends = [(F.col(f"__s{2 * i}"), F.col(f"__s{2 * i + 1}")) for i in range(len(probs))]
    # equal ends are no sum, which matters for infinite ones
    blend = {n: F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at))) for n, at, (a, b) in zip(probs, places, ends)}
    return picked.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[v.alias(n) for n, v in blend.items()])


def with_range(rows: DataFrame, ends: DataFrame, names: Sequence[str]) -> DataFrame:
    if names:
        return join_on(rows, ends, names, null_safe=True)
    one = ends.select(F.struct(LOW, HIGH).alias("s")).scalar()
    return rows.withColumns({LOW: one[LOW], HIGH: one[HIGH]})


def _buckets(rows: DataFrame, keys: Sequence[str], low: str = LOW, high: str = HIGH) -> DataFrame:
    """Weight, smallest and largest value of each bucket between the ends that rows carry. Buckets follow the order of the
    values, whatever is rounded on the way."""
    v, half = F.col("__v"), F.lit(0.5)
    share = F.try_divide(v * half - F.col(LOW) * half, F.col(HIGH) * half - F.col(LOW) * half)
    inner = F.greatest(F.lit(0), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
    bucket = F.when(F.isnan(v), BUCKETS + 1).when(v == float("inf"), BUCKETS).when(v == float("-inf"), -1).otherwise(F.coalesce(inner, F.lit(0)))
    return rows.groupBy(*keys, bucket.cast("int").alias("__b")).agg(F.sum("__n").alias("__c"), F.min("__v").alias(low), F.max("__v").alias(high))


def _before(ordered: Window) -> Column:
    return F.coalesce(F.sum("__c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _holding(placed: DataFrame, rank: Column, kept: list) -> DataFrame:
    """The bucket that holds a rank, and the rank within it."""
    inside = (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__c"))
    return placed.where(inside).select(*kept, (rank - F.col("__before")).alias("__rank"), "__c", LOW, HIGH)


def _in_ranges(rows: DataFrame, ranges: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows within each of the ranges of their group."""
    ranges = ranges.select(*names, LOW, HIGH).distinct()
    inside = F.col("__v").between(F.col(LOW), F.col(HIGH))
    if names:
        return join_on(rows, ranges, names, null_safe=True).where(inside)
    listed = [(r[LOW], r[HIGH]) for r in ranges.collect()]  # two for each quantile at most
    if not listed:
        return rows.where(F.lit(False)).withColumns({LOW: F.lit(0.0), HIGH: F.lit(0.0)})
    rows = rows.where(reduce(or_, [F.col("__v").between(a, b) for a, b in listed]))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias(LOW), F.lit(b).alias(HIGH)) for a, b in listed]))
    return rows.withColumn("__r", pairs).select("__v", "__n", F.col(f"__r.{LOW}"), F.col(f"__r.{HIGH}")).where(inside)


def median_iqr(df: DataFrame, value: str, keys: Sequence[str] = (), median: str = "median", iqr: str = "iqr") -> DataFrame:
    q = exact_quantiles(df, value, {median: 0.5, "__q1": 0.25, "__q3": 0.75}, keys)
    return q.withColumn(iqr, F.col("__q3") - F.col("__q1")).drop("__q1", "__q3")


def within_fence(df: DataFrame, value: str, keys: Sequence[str] = (), width: float = 2.0) -> DataFrame:
    """Rows no further from the group median than ``width`` interquartile ranges."""
    stats = median_iqr(df, value, keys, "__median", "__iqr")
    rows = join_on(df, stats, keys, null_safe=True) if keys else df.withColumns(
        {c: stats.select(c).scalar() for c in ("__median", "__iqr")})
    return rows.where(F.abs(F.col(value) - F.col("__median")) <= F.col("__iqr") * width).drop("__median", "__iqr")
