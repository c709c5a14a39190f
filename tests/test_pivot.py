"""Pivot margins on fixture F1 (expected cells computed with pandas, FIXTURES.md)."""

import pytest

from quarry.operators.pivot import pivot


@pytest.fixture(scope="module")
def f1(spark):
    rows = [("a", "x", 1.0, 1.0), ("a", "y", 2.0, None), ("b", "x", 3.0, 3.0),
            (None, "x", 4.0, 4.0), ("b", None, 5.0, 5.0), ("c", "x", None, 7.0)]
    return spark.createDataFrame(rows, "r string, c string, v double, w double")


def as_dict(df, key="r"):
    return {r[key]: tuple(r[1:]) for r in df.collect()}


def test_sum_one_value(f1):
    got = as_dict(pivot(f1, ["r"], ["c"], ["v"], "sum"))
    assert got == {"a": (1, 2, 3), "b": (3, None, 3), "c": (0, None, None), "Total": (4, 2, 6)}


def test_sum_two_values(f1):
    out = pivot(f1, ["r"], ["c"], ["v", "w"], "sum")
    assert out.columns == ["r", "v_x", "v_y", "v_Total", "w_x", "w_y", "w_Total"]
    got = as_dict(out)
    assert got["a"] == (1, 2, 1, 1, 0, 1)
    assert got["b"] == (3, None, 3, 3, None, 3)
    assert got["c"] == (0, None, None, 7, None, None)
    assert got["Total"] == (4, None, 4, 4, None, 4)


def test_mean_no_columns(f1):
    got = as_dict(pivot(f1, ["r"], [], ["v"], "mean"))
    assert got == {"a": (1.5,), "b": (4.0,), "Total": (2.75,)}


def test_sum_two_values_no_columns(f1):
    got = as_dict(pivot(f1, ["r"], [], ["v", "w"], "sum"))
    assert got == {"a": (3, 1), "b": (8, 8), "c": (0, 7), "Total": (9, 9)}


def test_count(f1):
    got = as_dict(pivot(f1, ["r"], ["c"], ["v"], "count"))
    assert got == {"a": (1, 1, 2), "b": (1, None, 1), "c": (0, None, None), "Total": (2, 1, 3)}


def test_median(f1):
    got = as_dict(pivot(f1, ["r"], ["c"], ["v"], "median"))
    assert got["a"][:2] == (1.0, 2.0)
    assert got["b"][0] == 3.0
    assert got["Total"][2] == 2.0


def test_two_column_keys(spark):
    df = spark.createDataFrame([("a", "x", "p", 1.0), ("a", "x", "q", 2.0), ("b", "y", "q", 3.0)],
                               "r string, c string, e string, v double")
    out = pivot(df, ["r"], ["c", "e"], ["v"], "sum")
    assert out.columns == ["r", "x_p", "x_q", "y_q", "Total"]


def test_row_order_is_native(spark):
    df = spark.createDataFrame([(10, 1.0), (9, 2.0), (100, 3.0)], "k int, v double")
    out = pivot(df, ["k"], [], ["v"], "sum")
    assert [r["k"] for r in out.collect()] == ["9", "10", "100", "Total"]
