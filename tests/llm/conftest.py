import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of (id, text) pairs, in the shape of the test tables."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in any column, empty and blank texts, a very long one, repeated rows and repeated ids."""
    return docs((1, "the quick brown fox"), (1, "the quick brown fox"), (1, "another text of this id"), (None, "the quick brown fox"), (None, None), (2, None), (3, ""), (4, " \n\t"), (5, "word " * 60_000))
