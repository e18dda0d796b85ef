"""Products of items over shared features: co-occurrence, correlation, distance.

The direct form joins a table to itself on the feature and shuffles every pair of items of every feature. Here a feature is one
row with its items, a task adds up the pairs of many features at once with numpy, and only sums are shuffled: one row for each pair
that meets and each batch of features. Where a batch has few items for its pairs, their matrix is multiplied as a whole; otherwise
its pairs are listed in tiles of bounded size and added up by sorting. The number of items is not bounded, and pairs that never
meet cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import materialise
from .joins import join_on, rows_in

#: Items of a batch that are multiplied as one matrix at most, cells of that matrix at once, pairs of a tile.
DENSE, CELLS, TILE = 1_024, 4_000_000, 1 << 20
SUMS = ["n_both", "dot", "a_with_b", "b_with_a"]


def feature_rows(df: DataFrame, item: str, feature: Sequence[str], value: str | None = None) -> DataFrame:
    """One row per feature with its items (``__i``) and their summed values (``__v``, 1 without a value)."""
    amount = F.lit(1.0) if value is None else F.coalesce(F.sum(value).cast("double"), F.lit(0.0))
    one = df.where(F.col(item).isNotNull()).groupBy(*feature, item).agg(amount.alias("__v"))
    rows = one.groupBy(*feature).agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col("__v").alias("v"))).alias("__e"))
    return rows.select(*feature, F.col("__e.i").alias("__i"), F.col("__e.v").alias("__v"))


def item_products(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over features, per group of ``keys``, for all pairs of items that meet in a feature, from ``feature_rows``.

    Columns: keys, item_a, item_b (item_a < item_b), n_both (features with both), dot (sum of products), a_with_b (what a has
    where b is present), b_with_a.
    """
    keys = list(keys)
    kind = rows.schema["__i"].dataType.elementType
    schema = StructType([*[rows.schema[k] for k in keys], StructField("item_a", kind), StructField("item_b", kind), StructField("n_both", LongType()),
                         *[StructField(s, DoubleType()) for s in SUMS[1:]]])
    partial = rows.select(*keys, "__i", "__v").mapInArrow(_adder(keys), schema)
    return partial.groupBy(*keys, "item_a", "item_b").agg(*[F.sum(s).alias(s) for s in SUMS])


def _adder(keys: list[str]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("__i")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            names, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            item, amount = rank[coded.indices.to_numpy(zero_copy_only=False)], batch.column("__v").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            by = np.lexsort((item, row))
            item, amount = item[by], amount[by]
            after = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(item)) - 1  # items of the same feature that follow
            group, heads = _groups(batch, keys)
            few = len(heads) == 1 and len(names) <= DENSE and batch.num_rows * len(names) ** 2 < 500 * after.sum()
            found = _dense(row, item, amount, batch.num_rows, len(names)) if few else _listed(row, item, amount, after, group, len(names))
            for g, a, b, *sums in found:
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).take(pa.array(heads[g])) for k in keys], names.take(pa.array(a)), names.take(pa.array(b)),
                    pa.array(sums[0].astype(np.int64)), *[pa.array(s) for s in sums[1:]]], names=[*keys, "item_a", "item_b", *SUMS])

    return add


def _groups(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row, and one row of each group."""
    if not keys:
        return np.zeros(batch.num_rows, np.int64), np.zeros(1, np.int64)
    codes = np.stack([batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys])
    _, heads, group = np.unique(codes, axis=1, return_index=True, return_inverse=True)
    return group.ravel(), heads


def _dense(row, item, amount, n, width):
    """All pairs by multiplying the matrix of features and items."""
    sums = [np.zeros((width, width)) for _ in SUMS[:3]]
    step = max(1, CELLS // max(1, width))
    for start in range(0, n, step):
        some = slice(*np.searchsorted(row, [start, start + step]))
        x, present = np.zeros((min(step, n - start), width)), np.zeros((min(step, n - start), width))
        x[row[some] - start, item[some]] = amount[some]
        present[row[some] - start, item[some]] = 1
        for s, more in zip(sums, (present.T @ present, x.T @ x, x.T @ present)):
            s += more
    both, dot, given = sums
    a, b = np.nonzero(np.triu(both, 1))
    yield np.zeros(len(a), np.int64), a, b, both[a, b], dot[a, b], given[a, b], given[b, a]


def _listed(row, item, amount, after, group, width):
    """Pairs in tiles of about ``TILE``, added up by pair."""
    tile = np.cumsum(after) // TILE
    for some in np.split(np.arange(len(item)), np.flatnonzero(np.diff(tile)) + 1) if len(item) else []:
        left = np.repeat(some, after[some])
        if not len(left):
            continue
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after[some]) - after[some], after[some])
        pair, at = np.unique((group[row[left]] * width + item[left]) * width + item[right], return_inverse=True)
        x, y = amount[left], amount[right]
        sums = [np.bincount(at, w, len(pair)) for w in (None, x * y, x, y)]
        yield pair // width // width, pair // width % width, pair % width, *sums


def _paired(own: DataFrame, pairs: DataFrame, columns: dict[str, str], complete: bool, mirror: bool) -> DataFrame:
    """Pairs of items with columns of both. ``complete`` adds the pairs that never meet, ``mirror`` each pair the other way
    round."""
    if complete:  # the caller asks for all pairs, so that the list of items is the shorter side of the result
        names = own.agg(F.collect_list("item")).scalar()
        every = own.select(F.col("item").alias("item_a"), F.explode(names).alias("item_b")).where("item_a < item_b")
        pairs = join_on(every, pairs, ["item_a", "item_b"], "left").na.fill(0, subset=[c for c in pairs.columns if c not in ("item_a", "item_b")])
    for side in "ab":
        pairs = pairs.join(own.select(F.col("item").alias(f"__{side}"), *[F.col(c).alias(f"{n}{side}") for c, n in columns.items()]),
                           F.col(f"item_{side}") == F.col(f"__{side}")).drop(f"__{side}")
    if not mirror:
        return pairs.withColumnsRenamed({"item_a": "item1", "item_b": "item2"})
    both = F.array(*[F.struct(F.col(x).alias("item1"), F.col(y).alias("item2")) for x, y in (("item_a", "item_b"), ("item_b", "item_a"))])
    return pairs.withColumn("__p", F.explode(both)).select("__p.*", *[c for c in pairs.columns if c not in ("item_a", "item_b")])


def _kept(df: DataFrame, item: str, items: DataFrame | Sequence | None) -> DataFrame:
    if items is None:
        return df
    return rows_in(df, item, items) if isinstance(items, DataFrame) else df.where(F.col(item).isin(list(items)))


def pairwise_phi(df: DataFrame, item: str, feature: str, items: DataFrame | Sequence | None = None, complete: bool = False,
                 mirror: bool = False) -> DataFrame:
    """Correlation of the presence of two items over features, for the pairs that meet with item1 < item2.

    ``items`` are the items to consider (a list, or a table with the item's column). Presence is binary: repeated rows of an item in
    a feature count once. The number of features is that of features with at least one of the items. Null where an item is in
    every feature. Columns: item1, item2, n_both, correlation.
    """
    rows = materialise(feature_rows(_kept(df, item, items).where(F.col(feature).isNotNull()), item, [feature]))  # a row per feature
    own = materialise(rows.select(F.explode("__i").alias("item")).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("n")))
    pairs = item_products(rows).select("item_a", "item_b", "n_both")
    pairs = _paired(own, pairs, {"n": "n"}, complete, mirror).withColumn("n", rows.agg(F.count(F.lit(1)).cast("double")).scalar())
    return pairs.select("item1", "item2", "n_both", phi(F.col("n"), F.col("n_both"), F.col("na"), F.col("nb")).alias("correlation"))


def phi(n: Column, both: Column, a: Column, b: Column) -> Column:
    return F.try_divide(n * both - a * b, F.sqrt(a * (n - a) * b * (n - b)))


def pairwise_distance(df: DataFrame, item: str, feature: str, value: str, complete: bool = False, mirror: bool = False) -> DataFrame:
    """Euclidean distance between the profiles of the pairs of items that meet in a feature; a missing cell counts 0."""
    rows = materialise(feature_rows(df, item, [feature], value))
    cells = rows.select(F.explode(F.arrays_zip("__i", "__v")).alias("c"))
    own = materialise(cells.groupBy(F.col("c.__i").alias("item")).agg(F.sum(F.col("c.__v") * F.col("c.__v")).alias("s")))
    pairs = _paired(own, item_products(rows).select("item_a", "item_b", "dot"), {"s": "s"}, complete, mirror)
    squared = F.col("sa") + F.col("sb") - 2 * F.col("dot")
    return pairs.select("item1", "item2", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))
