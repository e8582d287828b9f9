from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import DOC_SCHEMA, awkward_documents


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows as a table, and as (doc_id, text) pairs."""
    rows = awkward_documents()
    return spark.createDataFrame(rows, DOC_SCHEMA), [r[:2] for r in rows]


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
