"""Every registered query against its SQL text, and the same query on shuffled input."""

import os

import pytest

from sparkverbs import plans
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = plans.all_queries(), plans.all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="fixture tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    assert differences(got, con.sql(SQL[name]).to_arrow_table()) == []


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(SQL)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
