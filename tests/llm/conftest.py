import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text) as a table with all columns of documents, and clashing ones."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, _slice int, size long, chunk string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in rows], schema)

    return make
