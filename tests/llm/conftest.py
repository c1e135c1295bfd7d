import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, lang, source]) tuples."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
