"""Queries of the corpus operators against their SQL."""

import pytest

from oracle import database, normal
from tidewire.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = normal(df.columns, df.collect())
    result = database(SF_DIR).execute(SQL[name])
    expected = normal([d[0] for d in result.description], result.fetchall())
    assert got == expected and got[1]
