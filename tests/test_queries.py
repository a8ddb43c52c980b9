"""Every query of the core runs over the smallest tables; those with SQL give its rows."""

import pytest

from corpusloom.plans import catalog
from tests.oracle import assert_equal, connection

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_equal(df, con, SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 50
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
