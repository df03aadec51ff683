"""Every registered query against its SQL, on one scale (BASE_SF_DIR overrides it)."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, oracle_connection

FOLDER = os.environ.get("BASE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, oracle, name):
    status, detail = compare(spark, oracle, name, FOLDER)
    assert status in ("equal", "rows"), detail
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
