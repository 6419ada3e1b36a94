import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table (doc_id, text, lang, source, n_chars) from pairs of id and text."""

    def make(pairs, **columns):
        rows = [(i, t, columns.get("lang", "en"), columns.get("source", f"src{(i or 0) % 3}"), len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
