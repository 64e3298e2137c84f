"""Every registered query against its DuckDB oracle at sf0.001."""

import pytest

import __spark_entry__ as E
from assaylake.plans.catalog import QUERIES
from assaylake.plans.verify import check, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    missing = [k for k in QUERIES if k not in SQL]
    assert missing == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    assert check(df, con, SQL[name]) is None


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
