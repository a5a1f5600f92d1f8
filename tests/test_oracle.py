"""Every registered query against its SQL (TIDEWIRE_SF picks the data, default 0.001)."""

import os

import pytest

from oracle import compare, database
from tidewire.catalog import registry

SF_DIR = f"/root/testdata/sf{os.environ.get('TIDEWIRE_SF', '0.001')}"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry()))
def test_query_equals_sql(spark, con, name):
    query = registry()[name]
    assert query.sql is not None
    problem, _, _ = compare(spark, con, query, SF_DIR)
    assert problem is None
