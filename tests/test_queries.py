"""Every registered core query runs, and equals its SQL where there is one."""

import pytest

from plumbline import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(name, queries.QUERIES[name], oracle.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_query_runs(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
