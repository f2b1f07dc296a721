import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_id string, size string, members string, text_hash string, root int"
#: Columns that clash with names inside the operators.
EXTRA = ("x", "y", "z", "h", 1)


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) + EXTRA for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in any column, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"word{k % 5000}" for k in range(60_000))
    return documents(
        [
            (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long, None, None), (None, "no id here", "en", "s"), (None, "no id here", "en", "s"),
            (6, "twice the same row"), (6, "twice the same row"), (6, "another text with the same id"), (7, long + " end", "en", None), (8, "été \U0001f600 中文"),
        ]
    )
