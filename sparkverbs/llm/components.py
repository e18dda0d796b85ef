"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour (or self) of every ``u`` of (u, v), joined back to the edges. The hot side of a large star is split
    by the engine; only (u, least) is built as a group."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("__u")).select("u", "v", "m")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Large-star and small-star steps alternate until the edges stay the same; their number grows with the logarithm of the
    nodes. The work of a step is linear in the edges, and no neighbourhood is ever gathered in one place.
    """
    now = stored(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
