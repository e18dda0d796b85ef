"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: What separates words: space and the ASCII controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def words(text: Column) -> Column:
    """Words of a text, in order; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK, -1), lambda w: w != "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the folder in ``spark.checkpoint.dir`` and read it back.

    Unlike a checkpoint this computes the rows once, keeps the columns apart and tells the optimiser the true size.
    Files outlive lost executors; they go when the driver ends in order.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return
