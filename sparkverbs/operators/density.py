"""Two-dimensional Gaussian kernel density on a grid.

The kernel is a product of two one-dimensional kernels, so the sum over points is a product of two thin
matrices. Each task adds up the tiles of its own points with numpy and emits one sum per group and tile; only sums
are shuffled. A tile is a strip of the grid, so a grid may have any number of cells. No point-by-cell table is built and no
kernel tail is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .aggregates import exact_quantiles
from .joins import join_on

#: Cells of a tile, cells that a task holds, and cells of the kernel matrices at once.
TILE, HELD, AT_ONCE = 250_000, 16_000_000, 4_000_000


@dataclass(frozen=True)
class Grid:
    """Evenly spaced points that include both ends of each axis."""

    x_min: float
    x_max: float
    nx: int
    y_min: float
    y_max: float
    ny: int

    @staticmethod
    def from_bounds(x_min: float, x_max: float, y_min: float, y_max: float, per_unit: float = 2.0) -> "Grid":
        """Grid with ``per_unit`` points per unit of length on each axis."""
        count = lambda lo, hi: max(2, int(np.ceil(per_unit * (hi - lo))))
        return Grid(x_min, x_max, count(x_min, x_max), y_min, y_max, count(y_min, y_max))

    @staticmethod
    def around(df: DataFrame, x: str, y: str, nx: int, ny: int) -> "Grid":
        """Grid over the bounding box of the points; one aggregate, four numbers to the driver."""
        b = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        return Grid(float(b[0]), float(b[1]), nx, float(b[2]), float(b[3]), ny)

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.linspace(self.x_min, self.x_max, self.nx), np.linspace(self.y_min, self.y_max, self.ny)


def kernel_density(df: DataFrame, x: str, y: str, grid: Grid, bandwidth: float | tuple[float, float], group: str | None = None):
    """Density at every grid point, per group. The kernel deviation is a quarter of the bandwidth.

    Columns: group, ix, iy (from 0), x, y, density.
    """
    hx, hy = bandwidth if isinstance(bandwidth, tuple) else (bandwidth, bandwidth)
    sx, sy = hx / 4, hy / 4
    gx, gy = grid.axes()
    ny, keys = grid.ny, [group] if group else []
    width = max(1, TILE // ny)  # a tile is a strip of so many values of x
    strips = [gx[k:k + width] for k in range(0, grid.nx, width)]
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    schema = ", ".join([*[f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys], "__s int, __z array<double>"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kind = None

        def flush():
            for (g, strip), z in sums.items():
                first = [pa.array([g], type=kind)] if group else []
                yield pa.RecordBatch.from_arrays([*first, pa.array([strip], pa.int32()), pa.array([z.ravel()], type=pa.list_(pa.float64()))],
                                                 names=[*keys, "__s", "__z"])
            sums.clear()

        for batch in batches:
            xs, ys = batch.column("__x").to_numpy(), batch.column("__y").to_numpy()
            parts = [(None, slice(None))]
            if group:
                kind = batch.schema.field(group).type
                coded = batch.column(group).dictionary_encode(null_encoding="encode")
                codes = coded.indices.to_numpy()
                parts = [(g, codes == i) for i, g in enumerate(coded.dictionary.to_pylist())]
            for g, at in parts:
                px, py = xs[at], ys[at]
                step = max(1, AT_ONCE // (ny + width))
                for k in range(0, len(px), step):
                    ky = np.exp(-0.5 * ((gy[None, :] - py[k:k + step, None]) / sy) ** 2)
                    for i, strip in enumerate(strips):
                        kx = np.exp(-0.5 * ((strip[None, :] - px[k:k + step, None]) / sx) ** 2)
                        z = kx.T @ ky
                        sums[g, i] = sums[g, i] + z if (g, i) in sums else z
                        if len(sums) * TILE > HELD:
                            yield from flush()
        yield from flush()

    cells = points.mapInArrow(add, schema).select(*keys, "__s", F.posexplode("__z").alias("__p", "__v"))
    cells = cells.groupBy(*keys, "__s", "__p").agg(F.sum("__v").alias("__v"))
    # the points are counted apart; their kernels are evaluated once
    if group:
        cells = join_on(cells, points.groupBy(group).agg(F.count(F.lit(1)).alias("__total")), keys, null_safe=True)
    else:
        cells = cells.withColumn("__total", points.agg(F.count(F.lit(1))).scalar())
    ix, iy = F.expr(f"int(__s * {width} + __p div {ny})"), F.expr(f"int(__p % {ny})")
    return cells.select(
        *keys, ix.alias("ix"), iy.alias("iy"),
        (F.lit(grid.x_min) + ix * ((grid.x_max - grid.x_min) / (grid.nx - 1))).alias("x"),
        (F.lit(grid.y_min) + iy * ((grid.y_max - grid.y_min) / (grid.ny - 1))).alias("y"),
        (F.col("__v") / (F.col("__total") * (2 * np.pi * sx * sy))).alias("density"))


def normal_bandwidth(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Rule-of-thumb bandwidth per axis from the deviation, the interquartile range and the number of points."""
    n, dx, dy = df.agg(F.count(F.lit(1)), F.stddev_samp(x), F.stddev_samp(y)).first()
    out = []
    for column, deviation in ((x, dx), (y, dy)):
        q = exact_quantiles(df, column, {"a": 0.25, "b": 0.75}).first()
        out.append(4 * 1.06 * min(deviation, (q["b"] - q["a"]) / 1.34) * n ** -0.2)
    return tuple(out)


def density_levels(density: DataFrame, bins: int, name: str = "level") -> DataFrame:
    """Equal-width level of the density, 1 to ``bins``, over all cells."""
    top = density.agg(F.max("density")).scalar()
    level = F.ceil(F.try_divide(F.col("density"), top) * bins)
    return density.withColumn(name, F.greatest(F.lit(1), F.least(F.lit(bins), level)).cast("int"))
