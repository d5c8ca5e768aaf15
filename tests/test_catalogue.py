"""Every registered query runs, and gives the rows of its SQL where it has some."""

import pytest

from compare import assert_same, views
from tessera.plans import catalogue

ORACLE = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    if name in ORACLE:
        assert_same(df, views(small), ORACLE[name])
    else:
        assert df.count() > 0


def test_entry_points(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
