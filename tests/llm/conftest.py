"""Small frames with the awkward cases that every operator must stand."""

from __future__ import annotations

import pytest

LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number long, score double, key string, kept string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text, source) with columns whose names operators use themselves."""

    def made(rows):
        full = [
            (i, t, "en", s, None if t is None else len(t), 1, 0.5, "k", "yes") for i, t, s in
            ((r + ("a",))[:3] for r in rows)
        ]
        return spark.createDataFrame(full, SCHEMA)

    return made


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls, empty texts, a very long text, ties and repeated rows."""
    return docs(
        [
            (1, None), (2, ""), (3, " \t\n"), (4, LONG), (4, LONG), (5, "a b c d e f g"), (6, "a b c d e f g"), (6, "a b c d e f g"),
            (None, "a b c d e f g"), (None, "no id"), (7, "x", None), (8, "née 漢字 😀   end", "b"), (9, "a\nb\n\na"),
        ]
    )


@pytest.fixture(scope="session")
def nothing(docs):
    return docs([])
