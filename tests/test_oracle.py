"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest

from hitweave.plans import load
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
R = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("key", sorted(R.QUERIES))
def test_query(spark, con, key):
    df = R.QUERIES[key](spark, SF)
    if key in R.ORACLES:
        assert compare(df, con, R.ORACLES[key]) is None
    else:
        assert df.columns and df.collect(), "no rows"
