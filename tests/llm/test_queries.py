import pytest

from kinfold.llm import queries
from tests.oracle import SF, connect, same

CON = connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), CON, queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
