from __future__ import annotations

import pytest

DOCUMENT_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text) rows; the other columns are null."""

    def make(rows, extra: str = ""):
        width = 3 + (extra.count(",") + 1 if extra else 0)
        filled = [(*row, *[None] * width) for row in rows]
        return spark.createDataFrame(filled, DOCUMENT_COLUMNS + (f", {extra}" if extra else ""))

    return make
