import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True)
def workers_find_the_library(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture
def frame(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with those the operators use inside."""
    def make(rows, **more):
        names = ["doc_id", "text", "lang", "source", "n_chars", "score", "sid", "key", "found", "n", "_bucket", "rank", "label"]
        data = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 1, "f", 2, 3, 4, 5) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, sid string, key long, found string, n int, _bucket int, rank int, label int"
        return spark.createDataFrame(data, schema).select(*names)
    return make
