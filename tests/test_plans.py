"""Plan checks over the registered queries (sf0.001): no Python evaluation anywhere, filters
and projections reach the scan, and the entry contract holds."""

import pytest

import __spark_entry__ as E
from quarry.operators.aggregate import group_agg
from conftest import SF001

SKIP_BUILD = {"csv_roundtrip", "csv_uri_roundtrip", "json_roundtrip", "report_quality",
              "kmeans_sizes", "kmeans_means"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SKIP_BUILD))
def test_no_python_in_plan(spark, name):
    p = plan_of(E.queries()[name](spark, SF001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_column_pruning_reaches_scan(spark):
    text = E.queries()["group_agg_min"](spark, SF001)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


def test_filter_pushdown(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    text = group_agg(li, "l_returnflag", "l_quantity", "sum")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)]" in text


def test_top_n_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan_of(E.queries()["top_n"](spark, SF001))
