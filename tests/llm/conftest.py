import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """documents from (doc_id, text, lang, source) rows."""

    def make(rows):
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)

    return make


@pytest.fixture
def odd(frame):
    """Nulls, empty and long texts, ties and repeated rows."""
    return frame(
        [
            (1, None, "en", "a"),
            (2, "", "en", None),
            (3, "x", None, "a"),
            (3, "x", None, "a"),
            (4, "the same words here again and again " * 3000, "en", "b"),
            (None, "no id at all", None, None),
            (5, " \t\n ", "de", "b"),
            (6, "the same words here again and again " * 3000, "en", "a"),
        ]
    )
