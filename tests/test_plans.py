"""What the physical plans must and must not contain."""

import os

import pytest
from pyspark.sql import functions as F

from sparkverbs import plans
from sparkverbs.operators import ordered, windows
from sparkverbs.session import shared_folder

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="fixture tables are not there")
QUERIES = plans.all_queries()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    text = physical(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_filter_and_columns_reach_the_scan(spark):
    text = formatted(QUERIES["filter_conj"](spark, FOLDER))
    assert "GreaterThan(l_quantity,30.0)" in text and "EqualTo(l_returnflag,R)" in text
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert "l_quantity" in schema and "l_extendedprice" not in schema and "l_tax" not in schema


def test_whole_table_number_has_no_single_task_window(spark):
    df = spark.range(1000).withColumn("v", F.rand(1))
    text = physical(ordered.number_rows(df, ["v", "id"]))
    # the rows are not shuffled again, only the heads of the partitions go through one task
    assert text.count("Exchange SinglePartition") <= 1 and "Exchange hashpartitioning" not in text
    few = ordered.number_rows(df.withColumn("k", F.col("id") % 3), ["v", "id"], ["k"])
    assert "BroadcastHashJoin" in physical(few) and physical(few).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("build", [lambda df: ordered.running_sum(df, "v", ["v", "id"], ["k"]), lambda df: ordered.lag_value(df, "v", ["v", "id"], ["k"])])
def test_scans_do_not_move_rows_again(spark, build):
    df = spark.range(1000).select("id", F.rand(1).alias("v"), (F.col("id") % 3).alias("k"))
    text = physical(build(df))
    rows, carry = text.split("BroadcastExchange", 1)
    assert "Exchange" not in rows.replace("BroadcastExchange", "") and "Window" not in rows  # only one row per partition is sorted and sent


def test_top_n_limits_before_its_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in physical(windows.top_n(df, 2, "id", ["k"]))


class Context:
    """The parts of a Spark session that say where intermediates go."""

    def __init__(self, master, setting=None, folder=None):
        self.master, self.setting, self.folder = master, setting, folder
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return self.setting if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder():
    assert shared_folder(Context("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    assert shared_folder(Context("yarn", None, "hdfs://c")) == "hdfs://c"
    with pytest.raises(ValueError):
        shared_folder(Context("spark://host"))
    local = Context("local[8]")
    assert shared_folder(local) == local.folder is not None


def test_intermediates_go_to_the_configured_folder(spark):
    assert spark.sparkContext.getCheckpointDir() is None or shared_folder(spark) in spark.sparkContext.getCheckpointDir()
