import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, long and repeated texts, ties."""
    long = " ".join(f"word{i % 97} thing{i % 13}" for i in range(8000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, 4),
        (4, long, "en", "a", len(long)),
        (5, "the same short text of a few words", "en", "b", 34),
        (6, "the same short text of a few words", "en", "b", 34),
        (6, "the same short text of a few words", "en", "b", 34),
        (7, "héllo wörld ñandú \U0001f600 end", None, "b", 22),
        (8, long + " tail", "de", None, 9),
    ]
    return spark.createDataFrame(rows, DOCS)
