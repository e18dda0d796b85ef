"""Polygons as ordered vertex rows (id, seq, x, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import divide
from ..session import materialise


def centroid(vertices: DataFrame, keys: Sequence[str], seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Signed area and centroid of each ring by the shoelace sums.

    ``seq`` counts the vertices of a ring without holes in the count. Each vertex meets its successor by an
    equi-join on (keys, seq), so a ring with very many vertices is still spread over tasks; the last vertex meets
    the first one through the ring size.
    """
    keys = list(keys)
    cross = F.col(x) * F.col("__y1") - F.col("__x1") * F.col(y)
    sums = _edges(vertices, keys, seq, x, y).groupBy(*keys).agg(
        (F.sum(cross) / 2).alias("area"),
        F.sum((F.col(x) + F.col("__x1")) * cross).alias("__cx"),
        F.sum((F.col(y) + F.col("__y1")) * cross).alias("__cy"))
    return sums.select(*keys, "area", divide("__cx", F.col("area") * 6).alias("cx"), divide("__cy", F.col("area") * 6).alias("cy"))


def _edges(vertices: DataFrame, keys: list[str], seq: str, x: str, y: str) -> DataFrame:
    """Each vertex with its successor (__x1, __y1)."""
    size = vertices.groupBy(*keys).agg(F.min(seq).alias("__first"), F.max(seq).alias("__last"))
    here = vertices.join(size, keys).withColumn(
        "__next", F.when(F.col(seq) == F.col("__last"), F.col("__first")).otherwise(F.col(seq) + 1))
    after = vertices.select(*keys, F.col(seq).alias("__next"), F.col(x).alias("__x1"), F.col(y).alias("__y1"))
    return here.join(after, [*keys, "__next"])


def main_part(vertices: DataFrame, keys: Sequence[str], ring: str = "ring", seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """The largest part of each shape: its outer ring, number of holes, area without holes, and centroid.

    Rings of a shape may come in any order and direction. A ring lies in another one if a ray from its first vertex crosses the
    edges of the other an odd number of times; only rings whose bounding boxes hold the vertex are tried. Rings in an even
    number of others are parts, the rest are holes of the smallest ring around them. Of equal parts the one with the smaller
    ring number is taken. Columns: keys, ring, n_holes, area, cx, cy.
    """
    keys = list(keys)
    own = materialise(centroid(vertices, [*keys, ring], seq, x, y).withColumn("area", F.abs("area")))  # a row per ring
    first = vertices.groupBy(*keys, ring).agg(F.min_by(F.struct(x, y), seq).alias("p"))
    first = first.join(own.select(*keys, ring, "area"), [*keys, ring])
    inner = first.select(*keys, F.col(ring).alias("__in"), F.col("p")[x].alias("__px"), F.col("p")[y].alias("__py"), F.col("area").alias("__in_area"))
    edges = _edges(vertices, [*keys, ring], seq, x, y)
    box = vertices.groupBy(*keys, ring).agg(*[f(c).alias(f"__{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    box = box.join(own.select(*keys, ring, F.col("area").alias("__out_area")), [*keys, ring])
    # the boxes decide which rings are tried at all; a ring can only lie in a larger one
    tried = inner.join(box, keys).where((F.col("__in") != F.col(ring)) & (F.col("__in_area") < F.col("__out_area"))
                                        & F.col("__px").between(F.col(f"__lo{x}"), F.col(f"__hi{x}")) & F.col("__py").between(F.col(f"__lo{y}"), F.col(f"__hi{y}")))
    tried = tried.select(*keys, ring, "__in", "__px", "__py", "__out_area")
    crosses = ((F.col(y) > F.col("__py")) != (F.col("__y1") > F.col("__py"))) & (
        F.col("__px") < (F.col("__x1") - F.col(x)) * (F.col("__py") - F.col(y)) / (F.col("__y1") - F.col(y)) + F.col(x))
    hits = tried.join(edges, [*keys, ring]).groupBy(*keys, ring, "__in", "__out_area").agg(F.count(F.when(crosses, 1)).alias("n")).where("n % 2 = 1")
    around = hits.groupBy(*keys, F.col("__in").alias(ring)).agg(F.count(F.lit(1)).alias("__depth"), F.min_by(ring, F.struct("__out_area", ring)).alias("__parent"))
    placed = own.join(around, [*keys, ring], "left").withColumn("__hole", F.coalesce(F.col("__depth") % 2 == 1, F.lit(False)))
    part = F.when(F.col("__hole"), F.col("__parent")).otherwise(F.col(ring))
    sign = F.when(F.col("__hole"), -1.0).otherwise(1.0)
    parts = placed.groupBy(*keys, part.alias(ring)).agg(
        F.count(F.when(F.col("__hole"), 1)).alias("n_holes"), F.sum(sign * F.col("area")).alias("area"),
        *[(F.sum(sign * F.col("area") * F.col(c)) / F.sum(sign * F.col("area"))).alias(c) for c in ("cx", "cy")])
    best = F.max_by(F.struct(ring, "n_holes", "area", "cx", "cy"), F.struct(F.col("area"), -F.col(ring)))
    return parts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def segments(points: DataFrame, order_by: Sequence, x: str, y: str, keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Each point with the point before it on the route (x_from, y_from); null for the first."""
    from .ordered import ordered_scan

    return ordered_scan(points, order_by, keys, previous={"x_from": (x, None), "y_from": (y, None)}, bounded=bounded)
