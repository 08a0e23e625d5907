"""Small document tables for the training-text operators."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text[, source])`` rows, with columns that clash with results."""

    def make(rows):
        full = [
            (row[0], row[1], "en", row[2] if len(row) > 2 else "s", len(row[1] or "")) for row in rows
        ]
        frame = spark.createDataFrame(full, DOCUMENTS)
        return frame.selectExpr("*", "-1 AS size", "'x' AS kept", "'y' AS component_id", "0 AS start")

    return make


def rows_by_id(frame, key="doc_id"):
    """Rows of a small frame by their id."""
    return {row[key]: row for row in frame.collect()}
