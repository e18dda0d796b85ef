"""A folder of tables as one lazily read bundle."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Bundle(Mapping):
    """Tables by name; a table is opened when it is asked for. ``bundle.orders`` is ``bundle["orders"]``."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._names, self._open = list(names or TABLES), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def load_bundle(spark: SparkSession, folder: str, names: list[str] | None = None) -> Bundle:
    return Bundle(spark, folder, names)
