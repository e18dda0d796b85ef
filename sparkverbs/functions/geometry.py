"""Plane geometry for layouts, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .nulls import ColumnOrName, as_col
from .numeric import floor_mod


def circle_point(position: Column, n: Column, offset: float = 0.0) -> Column:
    """Point of item ``position`` (from 1) of ``n`` items spread evenly on the unit circle."""
    angle = (position - 1) / n * (2 * math.pi) + offset
    return F.struct(F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def upright_angle(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Angle in degrees for a label at (x, y) on a circle, in (-90, 90] so that text is never upside down."""
    angle = F.degrees(F.atan2(as_col(y), as_col(x)))
    return F.lit(90.0) - floor_mod(F.lit(90.0) - angle, 180.0)


def radial_angle(angle: ColumnOrName) -> Column:
    """Same aim for an angle in degrees, as a value in [270, 450)."""
    return floor_mod(as_col(angle) - 90, 180.0) + 270


def polar(radius: Column, turn: Column) -> tuple[Column, Column]:
    """Point at ``turn`` radians, counted from straight up."""
    return radius * F.cos(turn + math.pi / 2), radius * F.sin(turn + math.pi / 2)


def petal(value: Column, number: Column, n: int, gap: float = 0.2) -> Column:
    """Petal ``number`` of a flower with ``n`` petals of length ``value``.

    A petal is a triangle from the centre and a circle on its outer side, both moved outwards by ``gap``.
    Fields: x1, y1, x2, y2, x3, y3 (corners), x0, y0, r (circle).
    """
    step = 2 * math.pi / n
    start, end = (number - 1) * step, number * step
    middle = start + step / 2
    dx, dy = polar(F.lit(gap), middle)
    ax, ay = polar(value, start)
    bx, by = polar(value, end)
    cx, cy = polar(value / math.cos(step / 2), middle)
    shape = {"x1": ax + dx, "y1": ay + dy, "x2": bx + dx, "y2": by + dy, "x3": dx, "y3": dy,
             "x0": cx + dx, "y0": cy + dy, "r": value * math.tan(step / 2)}
    return F.struct(*[v.alias(k) for k, v in shape.items()])


# Room around a node, and between the two directions of a link.
PAD, SIDE = 0.06, 0.05


def link_ends(x0, y0, x1, y1, r0, r1, pad: float = PAD, side: float = SIDE) -> Column:
    """End points of a directed link, moved off its nodes and to one side so that both directions show.

    Links that run left, or straight down, are handled with their ends swapped and stay in swapped order;
    ``direction`` is 1 for right or straight up and -1 otherwise. Fields: x_from, y_from, x_to, y_to, direction.
    """
    x0, y0, x1, y1, r0, r1 = map(as_col, (x0, y0, x1, y1, r0, r1))
    forward = (x1 > x0) | ((x1 == x0) & (y1 > y0))
    pick = lambda a, b: F.when(forward, a).otherwise(b)
    sign = pick(F.lit(1.0), F.lit(-1.0))
    ax, ay, ar = pick(x0, x1), pick(y0, y1), pick(r0, r1) + pad
    bx, by, br = pick(x1, x0), pick(y1, y0), pick(r1, r0) + pad
    angle = F.atan2(by - ay, bx - ax)
    sx, sy = -sign * side * F.sin(angle), sign * side * F.cos(angle)
    return F.struct((ax + ar * F.cos(angle) + sx).alias("x_from"), (ay + ar * F.sin(angle) + sy).alias("y_from"),
                    (bx - br * F.cos(angle) + sx).alias("x_to"), (by - br * F.sin(angle) + sy).alias("y_to"),
                    sign.cast("int").alias("direction"))


# Half the height of a ribbon on the rank axis, and the room that a label of a length needs.
HALF_HEIGHT, LABEL_POWER, LABEL_SCALE = 0.075, 0.95, 0.00825


def ribbon_corners(rank, start, end, offset, ticks, ranks: int = 101, mirrored: bool = False) -> dict[str, Column]:
    """Corners of a ribbon from a rank axis (x1, x2) to a band axis (x3, x4)."""
    rank, start, end, offset, ticks = map(as_col, (rank, start, end, offset, ticks))
    side = -1.0 if mirrored else 1.0
    return {"x1": offset * side, "y1": (rank - HALF_HEIGHT) * (-2 / ranks) + 1,
            "x2": offset * side, "y2": (rank + HALF_HEIGHT) * (-2 / ranks) + 1,
            "x3": F.lit(side), "y3": start * 2 / ticks - 1,
            "x4": F.lit(side), "y4": end * 2 / ticks - 1}


def label_offset(text: ColumnOrName) -> Column:
    """Room on the axis that a label of this length needs."""
    return F.pow(F.char_length(as_col(text)) / 2, F.lit(LABEL_POWER)) * LABEL_SCALE


def quadrant_offset(number: ColumnOrName, size: float = 0.25) -> Column:
    """Place of sub-item ``number`` (1 to 4) in a 2 x 2 block: the first two right, odd ones up."""
    number = as_col(number)
    dx = F.when(number > 2, -size).otherwise(size)
    dy = F.when(floor_mod(number, 2) == 0, -size).otherwise(size)
    return F.struct(dx.alias("dx"), dy.alias("dy"))


def shade_triangle(saturation: ColumnOrName, lightness: ColumnOrName) -> Column:
    """Fold the (saturation, lightness) square into a triangle with black and white at its lower and upper tip."""
    s, l = as_col(saturation), as_col(lightness)
    half = 1 / math.tan(math.pi / 3)
    x = F.when(l > 0.5, (F.lit(2.0) - l * 2) * s).otherwise(l * 2 * s)
    return F.struct(x.alias("x"), (l * (2 * half) - half).alias("y"))
