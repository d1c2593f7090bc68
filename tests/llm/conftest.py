import pytest

EDGE_TEXTS = [None, "", "  \n\t ", "one", "a b c", "same words here again", "same words here again", "é ñ 中 \x0b x", "w " * 40_000, "x" * 300_000]


@pytest.fixture
def edge_docs(spark):
    """Null keys and texts, empty and very long texts, repeated rows, and columns that clash with results."""
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", "x", 1.0) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(5, EDGE_TEXTS[5], "s1", "x", 1.0), (None, "keyless text of some words", None, None, None), (None, None, "s0", "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, kept STRING, score DOUBLE")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)
