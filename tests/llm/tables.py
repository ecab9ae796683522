"""Fixtures of these tests: the smallest given tables, and documents made from rows."""

import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from texts, or from (doc_id, text[, source]) rows."""

    def make(rows):
        full = []
        for k, row in enumerate(rows):
            doc_id, text, *more = row if isinstance(row, tuple) else (k, row)
            full.append((doc_id, text, "en", more[0] if more else "src", len(text or "")))
        return spark.createDataFrame(full, DOCUMENTS)

    return make
