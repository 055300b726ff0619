import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a column with a clashing name."""
    rows = [(1, "a b c d e f g", "en", "s1", 13, "x"), (1, "a b c d e f g", "en", "s1", 13, "x"), (None, "null id " * 30, "en", None, 5, None), (3, None, None, "s1", None, "y"), (4, "", "fr", "s2", 0, "z"), (5, "lorem ipsum dolor " * 30_000, "fr", "s2", 1, "w"), (6, " \n\t\n ", "de", None, 5, "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string")
