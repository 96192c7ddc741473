"""Every registered query against its SQL on the smallest given tables, and the entry points."""

import pytest

import __spark_entry__ as entry
from checks.compare import connection, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["run_id", "prompt_pos", "accuracy", "rank", "is_best"]
