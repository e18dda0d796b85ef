"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that the plans of this library rely on. On a cluster, partition counts are left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", app: str = "sparkverbs") -> SparkSession:
    """Local session for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (builder.config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkverbs-"))
    return spark.sparkContext.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that doesn't have it installed."""
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparkverbs-")) / "sparkverbs.zip"  # on the driver only, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it back: rows are computed once, columns stay apart, and values that
    depend on how rows were laid out (partition numbers) are the same in every later use, also after an executor is lost.

    Files go when the driver ends in order.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """Have a scratch path removed when the driver ends in order."""
    _written.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return
