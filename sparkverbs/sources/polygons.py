"""Polygon layers as ordered vertex rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

RINGS = "array<array<array<double>>>"


def rings_from_json(df: DataFrame, geometry: str) -> DataFrame:
    """Vertex rows (ring, seq, x, y) from coordinate text ``[[[x, y], ...], ...]``; ring 0 is the outer one."""
    rest = [c for c in df.columns if c != geometry]
    rings = df.select(*rest, F.posexplode(F.from_json(geometry, RINGS)).alias("ring", "__v"))
    points = rings.select(*rest, "ring", F.posexplode("__v").alias("seq", "__p"))
    return points.select(*rest, "ring", "seq", F.col("__p")[0].alias("x"), F.col("__p")[1].alias("y"),
                         (F.col("ring") > 0).alias("hole"))


def star_polygons(df: DataFrame, key: str, corners: int = 10, inner: float = 0.5) -> DataFrame:
    """A star per row, centred at (key, 0): vertex rows (key, seq, x, y) with alternating radius."""
    rows = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(corners - 1))).alias("seq"))
    radius = F.when(F.col("seq") % 2 == 0, 1.0).otherwise(inner)
    angle = F.col("seq") * (2 * math.pi / corners)
    return rows.withColumn("x", F.col(key) + radius * F.cos(angle)).withColumn("y", radius * F.sin(angle))


def nested_shape(key: str) -> Column:
    """Coordinate text of a shape per row, placed by its key: a square with a hole, a triangle, and a square that is the largest
    part if the key is odd."""
    def ring(points, scale: Column | None = None) -> Column:
        scale = F.lit(1) if scale is None else scale
        corners = [F.concat(F.lit("["), (F.col(key) * 100 + x + dx * scale).cast("string"), F.lit(","), (F.lit(y) + dy * scale).cast("string"), F.lit("]"))
                   for x, y, dx, dy in points]
        return F.concat(F.lit("["), F.concat_ws(",", *corners), F.lit("]"))

    square = lambda x, y, a: [(x, y, 0, 0), (x, y, a, 0), (x, y, a, a), (x, y, 0, a)]
    side = F.when(F.pmod(F.col(key), F.lit(2)) == 1, 5).otherwise(2)
    rings = [ring(square(0, 0, 4)), ring(square(1, 1, 1)[::-1]), ring([(8, 0, 0, 0), (8, 0, 3, 0), (8, 0, 0, 3)]), ring(square(20, 0, 1), side)]
    return F.concat(F.lit("["), F.concat_ws(",", *rings), F.lit("]"))
