"""Rows that every operator must take: nulls, empties, repeats, clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, n_words long, key long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """Documents from (doc_id, text), with further columns whose names clash with results."""
        return spark.createDataFrame([(i, t, "en", "s", None, 9.0, -1, -1, 5) for i, t in rows], DOCS)

    return make


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "One."), (5, "one."), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (None, "a b c d e f g h"), (7, "word " * 30000), (8, "É ß 日本 🙂\x00")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
