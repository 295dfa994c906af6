import pytest

from odd_rows import LONG, PLAIN

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = [
        (1, PLAIN, "en", "web", len(PLAIN)),
        (1, PLAIN, "en", "web", len(PLAIN)),
        (2, PLAIN, None, "books", len(PLAIN)),
        (3, None, "en", "web", None),
        (4, "", "en", None, 0),
        (5, " \n\t ", "en", "", 4),
        (6, "one", "de", "web", 3),
        (7, LONG, "en", "web", len(LONG)),
        (8, LONG + " end", "en", "books", len(LONG) + 4),
        (9, "übergröße \U0001f600 naïve\n\nzeile\r\n" * 3, "de", "web", 75),
        (None, "a row without an id but with more than five words", None, None, None),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 0, None), (7, 1, 0), (9, 0, 1), (99, 1, 1), (8, 5, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
