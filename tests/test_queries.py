import pytest

from evalgrove.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["metric", "value", "numerator", "denominator", "applicable"]
    assert df.count() == 8


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["resume_todo"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan
