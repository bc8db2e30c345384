import pytest


@pytest.fixture
def documents(spark):
    """A function from (doc_id, text) pairs to a table with more columns, some named as operators' own are."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, part string")

    return make
