import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, H string, node int, runs string, verdict int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang), with extra columns whose names clash."""

    def make(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", 1, "r", 2) for r in rows]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, very long, repeated and null-id rows."""
    return [(1, None), (2, ""), (3, " \n "), (4, "word " * 60_000), (5, "x" * 200_000), (None, "a null id"), (7, "twice the same"), (7, "twice the same"), (8, None, None)]
