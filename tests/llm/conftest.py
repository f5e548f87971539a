import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    sentence = "The quick brown fox jumps over the lazy dog near the river bank today. "
    rows = [
        (1, "", "en", "a", 0, 0.5, "x"),
        (2, None, "en", None, None, None, None),
        (3, "word", None, "a", 4, 1.0, "y"),
        (4, sentence * 3, "en", "b", 0, 0.1, None),
        (4, sentence * 3, "en", "b", 0, 0.1, None),
        (5, sentence * 3, "de", "b", 0, 0.1, "z"),
        (None, "a text without any id at all in this table", "fr", "c", 1, None, None),
        (7, "  \n\t \n", "en", "a", 5, None, None),
        (8, "1234 5678 !!! ???", "en", "a", 5, None, None),
        (9, "x" * 20000, "en", "a", 20000, None, None),
        (10, "é ü 日本語 " * 50, "en", "a", 5, None, None),
        (11, "lorem ipsum dolor sit amet " * 800, "la", "a", 5, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
