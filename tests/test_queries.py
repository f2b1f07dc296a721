"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    ours = spark_rows(QUERIES[name](spark, SF))
    theirs = duck_rows(connection, ORACLES[name])
    assert ours == theirs


# The full tuning grid is left to the registered query; test_learning runs a small one.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"als_cv"}))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "item_id", "stars"]
