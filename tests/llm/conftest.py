import pytest


@pytest.fixture
def docs_of(spark):
    """documents(doc_id, text) with columns whose names clash with outputs and helpers."""
    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    return make
