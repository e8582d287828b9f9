"""Every registered query against its SQL, on the smallest driver tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from check_oracles import compare, connect

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    verdict, *_ = compare(spark, con, SF_DIR, name, driver.queries()[name], driver.oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    assert "unit_id" in driver.entry(spark).columns
