"""Every registered query against its SQL in DuckDB on the smallest data."""

import pytest

from hazewell.plans import QUERIES
from tests.oracle import run_all

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return {key: (ok, text) for key, ok, text, _ in run_all(spark, FOLDER, list(QUERIES))}


@pytest.mark.parametrize("key", list(QUERIES))
def test_matches_sql(results, key):
    ok, text = results[key]
    assert ok, text
