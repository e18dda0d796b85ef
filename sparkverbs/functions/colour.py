"""Colour spaces as column arithmetic: hex, RGB, HLS and CIE L*a*b* (D65 white)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnOrName, as_col
from .text import hex_byte

# sRGB primaries to CIE XYZ and back, D65 white point, L*a*b* constants.
XYZ_FROM_RGB = [[0.4124564, 0.3575761, 0.1804375],
                [0.2126729, 0.7151522, 0.0721750],
                [0.0193339, 0.1191920, 0.9503041]]
RGB_FROM_XYZ = [[3.2404542, -1.5371385, -0.4985314],
                [-0.9692660, 1.8760108, 0.0415560],
                [0.0556434, -0.2040259, 1.0572252]]
WHITE_D65 = [0.95047, 1.0, 1.08883]
LAB_EPSILON = 216 / 24389
LAB_KAPPA = 24389 / 27


def hex_to_rgb(c: ColumnOrName) -> Column:
    """``#rrggbb`` to a struct r, g, b with values in 0..1."""
    c = as_col(c)
    channel = lambda start: F.conv(F.substring(c, start, 2), 16, 10).cast("double") / 255
    return F.struct(channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """Channels in 0..1 to ``#rrggbb``; channels are bounded and rounded half-even."""
    byte = lambda x: hex_byte(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255))
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def rgb_to_hls(r: Column, g: Column, b: Column) -> Column:
    """Struct h (degrees), l, s."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread, total = top - low, top + low
    light = total / 2
    sat = F.when(spread == 0, 0.0).when(light <= 0.5, F.try_divide(spread, total)) \
           .otherwise(F.try_divide(spread, F.lit(2.0) - total))
    sector = F.when(spread == 0, 0.0) \
              .when(top == r, F.try_divide(g - b, spread)) \
              .when(top == g, F.try_divide(b - r, spread) + 2) \
              .otherwise(F.try_divide(r - g, spread) + 4)
    hue = F.when(sector < 0, sector * 60 + 360).otherwise(sector * 60)
    return F.struct(hue.alias("h"), light.alias("l"), sat.alias("s"))


def hls_to_rgb(h: Column, l: Column, s: Column) -> Column:
    """Struct r, g, b in 0..1 from hue in degrees, lightness and saturation."""
    chroma = (F.lit(1.0) - F.abs(l * 2 - 1)) * s
    base = l - chroma / 2

    def channel(offset: float) -> Column:
        # the channel is a trapezium over the hue circle, shifted by a third per channel
        turn = F.pmod(h / 60 + offset, F.lit(6.0))
        wave = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(turn - 3) - 1))
        return base + chroma * wave

    return F.struct(channel(0.0).alias("r"), channel(-2.0).alias("g"), channel(-4.0).alias("b"))


def _mix(rows: list[list[float]], parts: list[Column]) -> list[Column]:
    return [sum((p * w for p, w in zip(parts[1:], row[1:])), parts[0] * row[0]) for row in rows]


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """Struct l, a, b of CIE L*a*b*."""
    linear = [F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))) for x in (r, g, b)]
    scaled = [v / w for v, w in zip(_mix(XYZ_FROM_RGB, linear), WHITE_D65)]
    fx, fy, fz = [F.when(t > LAB_EPSILON, F.cbrt(t)).otherwise((t * LAB_KAPPA + 16) / 116) for t in scaled]
    return F.struct((fy * 116 - 16).alias("l"), ((fx - fy) * 500).alias("a"), ((fy - fz) * 200).alias("b"))


def lab_to_rgb(l: Column, a: Column, b: Column) -> Column:
    """Struct r, g, b in 0..1 (values outside the gamut are not cut here)."""
    fy = (l + 16) / 116
    parts = [fy + a / 500, fy, fy - b / 200]
    xyz = [F.when(f * f * f > LAB_EPSILON, f * f * f).otherwise((f * 116 - 16) / LAB_KAPPA) * w
           for f, w in zip(parts, WHITE_D65)]
    curve = [F.when(v <= 0.0031308, v * 12.92)
              .otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
             for v in _mix(RGB_FROM_XYZ, xyz)]
    return F.struct(*[v.alias(n) for v, n in zip(curve, "rgb")])
