import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row_no long, key string, size string, pieces string, whole string, maybe string, sieve_word string, slot int"
)
LONG = "lorem ipsum dolor sit amet " * 40_000


def row(doc_id, text, lang="en", source="a"):
    """A document with extra columns whose names operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "k", "s", "p", "w", "m", "v", 2)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [
        row(1, "the quick brown fox jumps"), row(2, "the quick brown fox jumps"), row(2, "the quick brown fox jumps"),
        row(3, None), row(4, ""), row(5, " \t\n"), row(None, "an orphan text here"), row(None, "an orphan text here"),
        row(6, LONG), row(7, LONG + "x"), row(8, "the quick brown fox jumps", None, None), row(9, "ein kleiner Text", "de", "b"),
        row(10, "été à la plage", "fr", None), row(11, "12345 67 !!", None, "b"), (None,) * 13,
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
