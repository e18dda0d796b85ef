"""Regression, contingency residuals, principal axes and clusters."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import clamp, divide
from ..session import materialise
from .joins import join_on


def ols_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row with slope and intercept of y on x; rows with a missing value are left out."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def ols_augment(df: DataFrame, y: str, x: str) -> DataFrame:
    """Fitted value, residual and the negated residual sign on each row."""
    fit = ols_fit(df, y, x).select(F.struct("slope", "intercept").alias("m")).scalar()
    return (df.withColumn("fitted", fit["intercept"] + fit["slope"] * F.col(x))
            .withColumn("resid", F.col(y) - F.col("fitted"))
            .withColumn("sign", (-F.signum("resid")).cast("int")))


def chisq_residuals(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency table in long form with observed and expected counts and Pearson residuals.

    Every row level that occurs meets every column level that occurs; a pair that does not occur counts 0. Rows with a missing
    level are left out. Columns: row, column, observed, expected, residual.
    """
    # the table of counts is small against its input and read four times
    counts = materialise(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("observed")))
    rows = counts.groupBy(row).agg(F.sum("observed").alias("__row"))
    # the column levels as one list: each row level gets them all, which is the size of the table
    levels = counts.groupBy(column).agg(F.sum("observed").alias("__col")).agg(F.collect_list(F.struct(column, "__col")).alias("l")).scalar()
    total = counts.agg(F.sum("observed")).scalar()
    cells = rows.withColumn("__level", F.explode(levels)).select(row, F.col("__level")[column].alias(column), "__row", F.col("__level.__col"), total.alias("__all"))
    cells = join_on(cells, counts, [row, column], "left").withColumn("observed", F.coalesce("observed", F.lit(0).cast("bigint")))
    expected = divide(F.col("__row").cast("double") * F.col("__col"), F.col("__all"))
    return (cells.withColumn("expected", expected)
            .withColumn("residual", divide(F.col("observed") - F.col("expected"), F.sqrt("expected")))
            .select(row, column, "observed", "expected", "residual"))


def chisq_statistic(residuals: DataFrame) -> DataFrame:
    """One row with the test statistic and its degrees of freedom."""
    names = [c for c in residuals.columns if c not in ("observed", "expected", "residual")]
    return residuals.agg(
        F.sum(F.col("residual") * F.col("residual")).alias("statistic"),
        ((F.count_distinct(names[0]) - 1) * (F.count_distinct(names[1]) - 1)).alias("df"))


def clipped_residuals(residuals: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return residuals.withColumn("residual", clamp("residual", low, high))


def principal_axes(df: DataFrame, columns: Sequence[str], k: int = 2, prefix: str = "axis_") -> DataFrame:
    """Coordinates on the first k principal axes of the standardised columns; rows with a missing value are left out.

    One aggregate gives means, deviations and covariances; the axes of that small matrix become literals of a plain
    expression. The largest loading of an axis is positive. A column without deviation has no part in the axes.
    """
    columns = list(columns)
    rows = df.na.drop(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    one = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(columns)],
                   *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    gram = np.eye(len(columns))
    for i, j in pairs:
        spread = (one[f"d{i}"] or 0) * (one[f"d{j}"] or 0)
        gram[i, j] = gram[j, i] = one[f"c{i}_{j}"] / spread if spread else 0
    for i in range(len(columns)):
        gram[i, i] = 1.0 if one[f"d{i}"] else 0.0
    values, vectors = np.linalg.eigh(gram)
    axes = vectors[:, np.argsort(-values, kind="stable")[:k]]
    axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
    z = [(F.col(c) - one[f"m{i}"]) / one[f"d{i}"] if one[f"d{i}"] else F.lit(0.0) for i, c in enumerate(columns)]
    return rows.withColumns({f"{prefix}{a + 1}": sum((z[i] * float(axes[i, a]) for i in range(len(columns))), F.lit(0.0)) for a in range(axes.shape[1])})


def spanning_tree(distances: DataFrame, a: str = "item1", b: str = "item2", distance: str = "distance") -> DataFrame:
    """Smallest spanning tree (forest) of a table of distances: (a, b, distance) with a < b.

    Every round each part takes the nearest edge that leaves it (ties by the names of the ends), and parts joined by an edge
    become one; the number of parts at least halves. Edges within a part are passed over by an equi-join with the parts of both ends.
    """
    edges = materialise(distances.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(distance).alias("w")).where("a <> b").distinct())
    parts = materialise(edges.select(F.explode(F.array("a", "b")).alias("item")).distinct().withColumn("part", F.col("item")))
    tree = edges.limit(0)
    while True:
        at = lambda end: parts.select(F.col("item").alias(end), F.col("part").alias(f"p{end}"))
        apart = edges.join(at("a"), "a").join(at("b"), "b").where("pa <> pb")
        ends = F.array(*[F.struct(F.col(x).alias("part"), F.col(y).alias("other")) for x, y in (("pa", "pb"), ("pb", "pa"))])
        best = apart.select("a", "b", "w", F.explode(ends).alias("e")).groupBy(F.col("e.part").alias("part")).agg(
            F.min(F.struct("w", "a", "b", F.col("e.other").alias("other"))).alias("best"))
        best = materialise(best)
        if best.isEmpty():
            return tree.select(F.col("a").alias(a), F.col("b").alias(b), F.col("w").alias(distance))
        tree = materialise(tree.unionByName(best.select("best.a", "best.b", "best.w").distinct()))
        # two parts that chose each other: the smaller one leads; then every part follows to its leader
        lead = best.select("part", F.col("best.other").alias("up"))
        back = lead.select(F.col("part").alias("__part"), F.col("up").alias("__up"))
        lead = lead.join(back, F.col("up") == F.col("__part")).select(
            "part", F.when((F.col("__up") == F.col("part")) & (F.col("part") < F.col("up")), F.col("part")).otherwise(F.col("up")).alias("up"))
        while True:
            lead = materialise(lead)
            up = lead.select(F.col("part").alias("__part"), F.col("up").alias("__up"))
            after = lead.join(up, F.col("up") == F.col("__part")).select("part", "up", F.col("__up").alias("top"))
            if after.where("up <> top").isEmpty():
                break
            lead = after.select("part", F.col("top").alias("up"))
        parts = materialise(parts.join(lead, "part", "left").select("item", F.coalesce("up", "part").alias("part")))


def similarity_order(distances: DataFrame, item: str, a: str = "item1", b: str = "item2", distance: str = "distance") -> DataFrame:
    """Order that puts similar items next to each other: (item, position from 1, distance to the part already placed).

    A walk over the smallest spanning tree from the smallest item that always takes the nearest edge to a new item. For n items
    the distances have n * n rows; the tree that one task walks has n.
    """
    tree = spanning_tree(distances, a, b, distance)
    kind = distances.schema[a].dataType.simpleString()

    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for x, y, w in zip(edges[a], edges[b], edges[distance]):
            near.setdefault(x, []).append((w, x, y))
            near.setdefault(y, []).append((w, x, y))
        rows, seen = [], set()
        for start in sorted(near):  # a table in several pieces is walked piece by piece
            ahead = [(float("-inf"), start, start)] if start not in seen else []
            while ahead:
                w, x, y = heapq.heappop(ahead)
                new = y if x in seen else x
                if new in seen:
                    continue
                seen.add(new)
                rows.append((new, len(rows) + 1, None if w == float("-inf") else w))
                for e in near[new]:
                    if e[1] not in seen or e[2] not in seen:
                        heapq.heappush(ahead, e)
        return pd.DataFrame(rows, columns=[item, "position", "distance"])

    return tree.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(walk, f"`{item}` {kind}, position bigint, distance double")
