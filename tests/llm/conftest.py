import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, kept string, shard string, _cell int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta. " * 30, "en", "a", 10), (2, "", "en", "a", 0), (3, None, None, None, None), (4, " \t\n\x0b\x0c\r ", "de", "b", 7), (5, long, "en", "a", len(long)),
        (None, "no id here but enough words to count", "en", None, 1), (6, "same text twice", "fr", "b", 1), (6, "same text twice", "fr", "b", 1), (7, "same text twice", None, "b", 1),
        (8, "é中😀 ñandú <|endoftext|> it'll  do\n\n", "es", "c", 5), (9, "x" * 5000, "en", "c", 5000), (10, "1234 5678 !!!", "en", "c", 5),
    ]
    return spark.createDataFrame([(*r, 0.5, "h", "k", "s", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
