"""Literal tables and number sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sequence_between(df: DataFrame, first: Column, last: Column, name: str = "n", step: Column | None = None) -> DataFrame:
    """Every value from an aggregate of the table to another one."""
    span = df.agg(first.alias("__a"), last.alias("__b"))
    seq = F.sequence("__a", "__b") if step is None else F.sequence("__a", "__b", step)
    return span.select(F.explode(seq).alias(name))


def with_random(df: DataFrame, keys: Sequence[str], name: str = "random", seed: int = 1) -> DataFrame:
    """Uniform random number in [0, 1) per row, from the digest of its keys and the seed: the same however rows are spread."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys]))
    return df.withColumn(name, F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)))
