"""Colour columns and group colours, step by step so that no expression is computed twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import colour


def with_rgb(df: DataFrame, hex_col: str, name: str = "rgb") -> DataFrame:
    return df.withColumn(name, colour.hex_to_rgb(hex_col))


def with_space(df: DataFrame, space: str = "hls", rgb: str = "rgb") -> DataFrame:
    """Add the struct ``hls`` or ``lab`` from an rgb struct."""
    parts = [F.col(f"{rgb}.{c}") for c in "rgb"]
    convert = {"hls": colour.rgb_to_hls, "lab": colour.rgb_to_lab}[space]
    return df.withColumn(space, convert(*parts))


def with_hex(df: DataFrame, space: str = "hls", name: str = "hex") -> DataFrame:
    """Colour text from the struct ``hls`` or ``lab``."""
    back = {"hls": colour.hls_to_rgb, "lab": colour.lab_to_rgb}[space]
    fields = {"hls": "hls", "lab": "lab"}[space]
    out = df.withColumn("__rgb", back(*[F.col(f"{space}.{c}") for c in fields]))
    return out.withColumn(name, colour.rgb_to_hex(F.col("__rgb.r"), F.col("__rgb.g"), F.col("__rgb.b"))).drop("__rgb")


def average_colour(df: DataFrame, hex_col: str, keys: Sequence[str], name: str = "avg_color", space: str = "hls",
                   circular_hue: bool = False) -> DataFrame:
    """Mean colour per group, averaged per component in ``hls`` or ``lab``.

    The plain hue mean ignores the wrap at 360 degrees; ``circular_hue`` averages directions instead. Three (five)
    partial averages per group are all that is shuffled.
    """
    spread = with_space(with_rgb(df.select(*keys, hex_col), hex_col), space).select(*keys, f"{space}.*")
    means = {c: F.avg(c) for c in space}
    if space == "hls" and circular_hue:
        turn = F.radians("h")
        means["h"] = F.pmod(F.degrees(F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn)))), F.lit(360.0))
    grouped = spread.groupBy(*keys).agg(*[v.alias(c) for c, v in means.items()])
    packed = grouped.select(*keys, F.struct(*list(space)).alias(space))
    return with_hex(packed, space, name).drop(space)
