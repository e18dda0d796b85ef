"""Graphs as edge and vertex tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .cooccurrence import feature_rows, item_products
from .reshape import union_by_name
from .windows import top_n


def missing_vertices(edges: DataFrame, vertices: DataFrame, name: str = "name", ends: Sequence[str] = ("from", "to")):
    """End points of edges that the vertex table lacks; empty for a well-formed graph."""
    used = union_by_name(*[edges.select(F.col(e).alias(name)) for e in ends]).distinct()
    return used.join(vertices.select(name), name, "left_anti")


def with_vertices(edges: DataFrame, vertices: DataFrame, name: str = "name", ends: Sequence[str] = ("from", "to")) -> DataFrame:
    """Edges with the attributes of their end points as ``<end>_<attribute>``. An edge whose end point is not a vertex stops the
    query with an error; the check is part of the joins, so it needs no job of its own."""
    attributes = [c for c in vertices.columns if c != name]
    for end in ends:
        other = vertices.select(F.col(name).alias("__name"), *[F.col(c).alias(f"{end}_{c}") for c in attributes])
        edges = edges.join(other, F.col(end) == F.col("__name"), "left")
        what = F.concat(F.lit("an edge ends in something that is not a vertex: "), F.coalesce(F.col(end).cast("string"), F.lit("null")))
        kind = edges.schema[end].dataType
        edges = edges.withColumn(end, F.when(F.col("__name").isNotNull(), F.col(end)).otherwise(F.raise_error(what).cast(kind))).drop("__name")
    return edges


def adjacency(df: DataFrame, source: str, targets: Sequence[str]) -> DataFrame:
    """Weighted edges from one column to each of several others, stacked; target values become text. One scan, one aggregate."""
    pairs = F.array(*[F.struct(F.lit(t).alias("kind"), F.col(t).cast("string").alias("to")) for t in targets])
    rows = df.select(F.col(source).alias("from"), F.explode(pairs).alias("p"))
    return rows.groupBy("from", F.col("p.to").alias("to"), F.col("p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select("from", "to", "n", "kind")


def hierarchy(df: DataFrame, leaf: str, parent: str, weight: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Two-level tree: edges (from, to, weight) and vertices (name, level, total), root on level 3 with total 0.

    ``df`` holds one weight per (leaf, parent) or more; they are added up. Text names are made unique by level.
    """
    pairs = materialise(df.groupBy(parent, leaf).agg(F.sum(weight).alias("weight")))
    groups = pairs.groupBy(parent).agg(F.sum("weight").alias("weight"))
    low = pairs.select(F.col(parent).alias("from"), F.col(leaf).alias("to"), "weight")
    high = groups.select(F.lit(root).alias("from"), F.col(parent).alias("to"), "weight")
    leaves = pairs.groupBy(F.col(leaf).alias("name")).agg(F.sum("weight").alias("total"))
    vertices = union_by_name(
        leaves.withColumn("level", F.lit(1)),
        groups.select(F.col(parent).alias("name"), F.col("weight").alias("total"), F.lit(2).alias("level")),
        groups.agg((F.count(F.lit(1)) * 0).cast(groups.schema["weight"].dataType).alias("total"))
        .select(F.lit(root).alias("name"), "total", F.lit(3).alias("level")))
    return union_by_name(low, high), vertices


def attribute_broadcasts(df: DataFrame, group: Sequence[str], sender: str, weight: str, everyone: Column) -> DataFrame:
    """Total weight per (group, sender), where messages to everyone also count for each sender present in the group.

    ``everyone`` marks the messages that are addressed to all; they are not a sender of their own.
    """
    own = df.where(~everyone).groupBy(*group, sender).agg(F.sum(weight).alias(weight))
    shared = df.where(everyone).groupBy(*group).agg(F.sum(weight).alias("__shared"))
    joined = own.join(shared, list(group), "left")
    return joined.select(*group, sender, (F.col(weight) + F.coalesce("__shared", F.lit(0))).alias(weight))


def interaction_edges(df: DataFrame, outer: Sequence[str], scene: Sequence[str], member: str, weight: str) -> DataFrame:
    """Directed edges between members that share a scene, whoever occurs.

    The weight of s -> t per ``outer`` group is the sum, over scenes with both present, of what s has in the scene. A scene
    is one row with its members, and tasks add up the pairs of many scenes before anything is shuffled.
    """
    rows = feature_rows(df, member, [*outer, *scene], weight)
    pairs = item_products(rows, outer)
    ways = F.array(*[F.struct(F.col(f"item_{x}").alias("from"), F.col(f"item_{y}").alias("to"), F.col(f"{x}_with_{y}").cast(
        df.select(F.sum(weight)).schema[0].dataType).alias("weight")) for x, y in ("ab", "ba")])
    return pairs.select(*outer, F.explode(ways).alias("__e")).select(*outer, "__e.*")


def top_edges(edges: DataFrame, n: int, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Heaviest edges per group, ties kept."""
    return top_n(edges, n, weight, keys)
