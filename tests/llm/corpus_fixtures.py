import os

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing extra column."""
    rows = [
        (1, None, "en", "a", None, "x"),
        (None, "alone, with a null id", None, None, 21, None),
        (2, "", "en", "a", 0, "x"),
        (3, "the same words of the same row " * 3, "en", None, None, "x"),
        (3, "the same words of the same row " * 3, "en", None, None, "x"),
        (4, "one\n\n\ttwo three\n" * 8000, "de", "b", None, None),
        (5, "é ü 日本語 mail a.b@c.de now", "de", "b", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
