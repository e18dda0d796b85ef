"""Frame tables for animations: interpolation, schedules, held frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def tween(df: DataFrame, cell: Sequence[str], step: str, values: Sequence[str], nframes: int = 20) -> DataFrame:
    """Linear interpolation between the states of each cell at integer steps.

    A state is joined to the next one that its cell has, over the true distance: frame k after it (0 up to nframes times
    the distance) holds a + (b - a) * k / (nframes * distance). The last step of the table closes the series with one
    frame. The step is interpolated as well. Columns: cell, frame, step (as a number), values.
    """
    cell = list(cell)
    span = df.agg(F.struct(F.min(step).alias("lo"), F.max(step).alias("hi")).alias("s")).scalar()
    order = Window.partitionBy(*cell).orderBy(step)
    pairs = df.withColumns({"__last": F.col(step) == span["hi"], "__lo": span["lo"], "__next": F.lead(step).over(order),
                            **{f"__b_{v}": F.lead(v).over(order) for v in values}})
    distance = F.col("__next") - F.col(step)
    frames = pairs.where(F.col("__next").isNotNull() | F.col("__last")).withColumn("__k", F.explode(
        F.when(F.col("__last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (distance * nframes - 1).cast("int")))))
    blend = lambda v: F.when(F.col("__last"), F.col(v)).otherwise(
        F.col(v) + (F.col(f"__b_{v}") - F.col(v)) * (F.col("__k") / (nframes * distance)))
    return frames.select(*cell, ((F.col(step) - F.col("__lo")) * nframes + F.col("__k")).cast("int").alias("frame"),
                         (F.col(step) + F.col("__k") / nframes).alias(step), *[blend(v).alias(v) for v in values])


def schedule(df: DataFrame, round_col: str, frames: Column, name: str = "frame") -> DataFrame:
    """Repeat the rows of a round for each frame in the array expression ``frames``."""
    return df.withColumn(name, F.explode(frames))


def hold(df: DataFrame, index: str, every: int, repeats: int, name: str = "copy") -> DataFrame:
    """Repeat every ``every``-th frame ``repeats`` times, keep the others once; copies are numbered from 0."""
    times = F.when(F.pmod(F.col(index), F.lit(every)) == 0, repeats).otherwise(1)
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), times - 1)))
