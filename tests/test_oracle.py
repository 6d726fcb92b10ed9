"""Every registered query with an oracle: Spark result equals the DuckDB SQL (sf0.001)."""
import pytest

import __spark_entry__ as E
from check_oracle import compare, duck
from conftest import SF_SMALL

SQL = E.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), con, SQL[name])
    assert ok, f"{name}: {msg}"
