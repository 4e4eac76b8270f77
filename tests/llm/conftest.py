import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "n_words bigint, kept boolean, spans string, h bigint, id bigint, cells string, word string, line string"
)
EXTRA = (7, False, "x", 3, 4, "y", "z", "w")


@pytest.fixture
def make_docs(spark):
    """documents rows from (doc_id, text) or (doc_id, text, lang), with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), *EXTRA) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and blank texts, a long text and a repeated row."""
    return [(None, None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "word " * 60_000), (6, "same text here"), (6, "same text here")]
