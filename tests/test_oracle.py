"""Every query against its DuckDB counterpart."""

import pytest

from oracle.queries import ORACLE
from sangloc.plans.catalog import QUERIES
from tools_check import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_duckdb(spark, con, folder, name):
    result = compare(spark, con, folder, name)
    assert result.startswith("ok"), result
