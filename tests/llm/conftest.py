import os

os.environ.setdefault("OMP_NUM_THREADS", "1")  # small matrices; a pool of threads only waits for busy cores

import pytest  # noqa: E402


@pytest.fixture(autouse=True, scope="session")
def work_folder(spark, tmp_path_factory):
    """The sessions of these tests have no cluster, so they name their own folder for intermediates."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("work")))


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names clash with those of the operators."""

    def make(rows, parts=3):
        full = [(i, t, lang, src, None if t is None else len(t), 1, 2, "x") for i, t, lang, src in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, n int, id string").repartition(parts)

    return make


#: Null id, null, empty and blank text, repeated rows, a tie, null language and source.
ODD = [(None, "a few words stand here in a row", "en", "s"), (1, None, "en", "s"), (2, "", None, "s"), (3, " \t\n ", "en", None),
       (4, "one two three", "en", "s"), (4, "one two three", "en", "s"), (5, "ONE two three", "de", "t"), (6, "one", "en", "s")]
