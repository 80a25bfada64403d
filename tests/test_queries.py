import pytest

from kinfold.plans import registry
from tests.oracle import SF, connect, same

CON = connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), CON, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["i", "j", "score", "rk"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_inverted_index_has_no_nested_loop(spark):
    from kinfold.operators import pairs, sketches

    df = spark.createDataFrame([(i, j) for i in range(5) for j in range(9)], "entity int, item int")
    plan = pairs.register_pairs(sketches.oph(df, "item", 8))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
