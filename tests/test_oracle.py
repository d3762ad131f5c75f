"""Every registered query against its SQL on the smallest tables; queries without SQL must at least run."""

import pytest
from oracle import compare, connect

from strideframe.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(cached, con, name):
    got = QUERIES[name](cached, SF).toPandas()
    assert compare(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(cached, name):
    assert len(QUERIES[name](cached, SF).toPandas()) > 0
