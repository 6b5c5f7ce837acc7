"""Every registered query of the engine against its SQL."""

import pytest

import __spark_entry__
from marlstone.plans.registered import QUERIES, SQL
from tests.oracle import connect, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert name in SQL
    names, rows = rows_of_spark(QUERIES[name](spark, sf_dir))
    assert (names, rows) == rows_of_sql(con, SQL[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
