from __future__ import annotations

import re

import pytest

from patronlens.llm.queries import workers_find_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    workers_find_package(spark)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with a column whose name operators use inside."""

    def make(rows, lang="en"):
        full = [(i, t, lang, "src0", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string")

    return make


@pytest.fixture(scope="session")
def sample_texts():
    """(doc_id, text) of the smallest test documents."""
    import duckdb

    from pathlib import Path

    TESTDATA = Path("/root/testdata")

    return duckdb.sql(f"SELECT doc_id, text FROM '{TESTDATA}/sf0.001/documents.parquet' ORDER BY 1").fetchall()
