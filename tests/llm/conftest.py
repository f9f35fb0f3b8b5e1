"""Small tables that hold the awkward cases."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, word string, salt long"


@pytest.fixture(scope="session")
def documents(spark):
    """All texts of the smallest tables: rows (doc_id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text) rows -> documents with further columns whose names clash with those used inside."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "web", len(t or ""), 1, "w", 2) for d, t in rows], SCHEMA)

    return make
