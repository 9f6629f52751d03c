"""Every query with SQL gives the SQL's rows; every other one runs and gives rows of a fixed schema."""

import pytest

from tessera.plans import registry

SQL = registry.oracle_sql()
WITHOUT = sorted(registry.queries().keys() - SQL.keys())


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, data, same_rows, name):
    same_rows(registry.queries()[name](spark, data), SQL[name])


@pytest.mark.parametrize("name", WITHOUT)
def test_others_give_rows(spark, data, name):
    frame = registry.queries()[name](spark, data)
    assert frame.count() > 0


def test_entry_names_the_queries():
    import __spark_entry__ as entry

    assert registry.queries().keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
