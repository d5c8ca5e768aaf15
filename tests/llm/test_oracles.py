import pytest

from compare import assert_same, views
from tessera.llm import queries as llm


@pytest.mark.parametrize("name", llm.oracle_sql())
def test_query_against_sql(spark, small, name):
    assert_same(llm.queries()[name](spark, small), views(small), llm.oracle_sql()[name])
