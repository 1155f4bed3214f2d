import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "word", "x"), (3, "word", "x"), (4, "a b c d e f g h i j " * 3000, "y"),
        (None, "a text without an id", "z"), (5, "  \n\t ", None), (6, "é漢字🙂 ok\u0085x y", "q"), (7, "a text without an id", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, spans string")
