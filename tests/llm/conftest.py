"""Frames and awkward inputs that the corpus tests share."""

import pytest

NAMES = ("doc_id", "text")


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, and columns that clash with operators' own."""
    long = " ".join(f"word{i % 977} is here." for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "plain text here"), (4, "plain text here"), (None, "no id at all"), (5, "plain  text here"), (6, long), (7, long), (None, None)]
    return spark.createDataFrame([(i, t, "k", 1, "x") for i, t in rows], "doc_id long, text string, key string, n int, spans string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")
