import pytest

from tests.compare import rows_of, sql_rows
from verisift.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, data, name):
    assert rows_of(catalog.queries()[name](spark, data)) == sql_rows(data, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_filters_and_columns_reach_the_scan(spark, data):
    from verisift.session import table

    plan = table(spark, data, "evidence").where("provider = 'serper'").select("url")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(provider,serper)" in text and "ReadSchema: struct<provider:string,url:string>" in text
