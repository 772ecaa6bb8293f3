import pytest

#: Rows that any operator on documents must bear: nulls, empty and white texts, repeats, a clash of names, a long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", 1),
    (2, None, None, 2),
    (3, "", "en", 3),
    (4, " \t\n ", "en", 4),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", 5),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", 5),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss heute.", "de", None),
    (7, "word " * 20_000, "en", 7),
    (8, "x" * 70_000, "en", 8),
    (9, "日本語のテキスト 😀 <s> </s> <|endoftext|> a  b\t\tc", "xx", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with a column whose name clashes with those that operators make."""
    return spark.createDataFrame([(i, t, la, n, i, "s") for i, t, la, n in ODD], "doc_id long, text string, lang string, n_chars long, component_id long, row string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
