import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, ties, one very long text."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
        (2, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
        (3, None, None, None, None),
        (None, "a null id keeps its row", "en", "a", 23),
        (4, "", "en", "", 0),
        (5, " \n\t ", "en", "a", 4),
        (6, "word " * 60_000 + "end", "en", "c", 300_003),
        (7, "one", "en", "c", 3),
        (8, "naïve 日本語 \U0001f600 <|endoftext|> text", None, "a", 30),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
