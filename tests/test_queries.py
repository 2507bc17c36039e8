"""Every registered query runs, and equals its SQL where it has one."""

import pytest

from lodestone.plans import registry

from .compare import DATA, connection, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    names, expected = rows_of_sql(con, sql)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
