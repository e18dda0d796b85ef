import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkverbs.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows in random order over several partitions, so that nothing can lean on the input order."""

    def make(rows, schema, parts=3, seed=7):
        rows = list(rows)
        random.Random(seed).shuffle(rows)
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


@pytest.fixture
def rows():
    return rows_of
