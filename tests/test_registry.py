from __future__ import annotations

import pytest
from helpers import rows_by_name, sql_rows

from vectide.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    rows = df.collect()
    if name in registry.ORACLE_SQL:
        assert rows_by_name(df.columns, rows) == sql_rows(registry.ORACLE_SQL[name], small)
    else:
        assert rows


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 250
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())


def test_plan_prunes_and_pushes_down(spark, small):
    from vectide.plans.registry import table

    e = table(spark, small, "embeddings").where("vec_id < 8").select("vec_id")
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), LessThan(vec_id,8)]" in plan
    assert "ReadSchema: struct<vec_id:bigint>" in plan
