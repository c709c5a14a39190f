"""Edge-case fixtures F2-F5 (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import alerts as AL
from quarry.operators import bins as B
from quarry.operators import clean as C
from quarry.operators import columns as K
from quarry.operators import fit as T
from quarry.operators import profile as P
from quarry.operators import windows as W
from quarry.operators.aggregate import correlation
from quarry.operators.pivot import pivot


@pytest.fixture(scope="module")
def f2(spark):
    rows = [(0, 1.0, "x"), (1, 2.0, None), (2, None, None), (3, 2.0, None), (4, 1.0, "x")]
    return spark.createDataFrame(rows, "i int, a double, b string")


def test_f2_quality(f2):
    df = f2.drop("i")
    q = P.quality_score(df).first()
    assert (q["missing_cells"], q["duplicates"], q["quality"]) == (4, 2, 68.0)
    prof = {r["column"]: r for r in P.profile(df).collect()}
    assert prof["a"]["unique"] == 2 and prof["b"]["unique"] == 1
    c = P.central(df, "a").first()
    assert (c["mean"], c["median"], c["mode"]) == (1.5, 1.5, 1.0)


def test_f2_forward_fill(f2):
    a = [r["a"] for r in W.forward_fill(f2, "a", ["i"]).orderBy("i").collect()]
    b = [r["b"] for r in W.forward_fill(f2, "b", ["i"]).orderBy("i").collect()]
    assert a == [1, 2, 2, 2, 1] and b == ["x"] * 5


def test_f2_fills(f2):
    got = lambda df, c: [r[c] for r in df.orderBy("i").collect()]
    assert got(C.fill_missing(f2, "a", "mean"), "a") == [1, 2, 1.5, 2, 1]
    assert got(C.fill_missing(f2, "a", "median"), "a") == [1, 2, 1.5, 2, 1]
    assert got(C.fill_missing(f2, "a", "mode"), "a") == [1, 2, 1, 2, 1]
    assert got(C.fill_missing(f2, "b", "mode"), "b") == ["x"] * 5
    assert got(C.fill_constant(f2, "a", "7"), "a") == [1, 2, 7, 2, 1]
    assert C.drop_missing(f2, "a").count() == 4
    with pytest.raises(ValueError):
        C.fill_constant(f2, "a", "")
    with pytest.raises(ValueError):
        C.fill_constant(f2, "a", "abc")


def test_f2_duplicates(f2):
    df = f2.drop("i")
    assert P.duplicate_count(df).first()["duplicates"] == 2
    assert C.drop_duplicates(df).count() == 3


def test_f3_casts(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,)], "s string")
    assert [r["s"] for r in K.cast_column(df, "s", "int64").collect()] == [3, None, None]
    frac = spark.createDataFrame([("3.7",), ("2",)], "s string")
    with pytest.raises(ValueError):
        K.cast_column(frac, "s", "int64")
    big = spark.createDataFrame([("9007199254740993",)], "s string")
    assert K.cast_column(big, "s", "int64").first()["s"] == 9007199254740993
    ts = spark.createDataFrame([("2024-01-01",), ("x",)], "s string")
    got = [r["s"] for r in K.cast_column(ts, "s", "datetime").collect()]
    assert got[0].year == 2024 and got[1] is None


def test_f4_alert_boundary(spark):
    df = spark.createDataFrame([(float(v),) for v in list(range(1, 10)) + [100]], "v double")
    q = C.iqr_fences(df, ["v"]).first()
    assert (q["q1"], q["q3"]) == (3.25, 7.75)
    al = AL.alerts(df).collect()
    out = [a for a in al if a["issue"] == "Outliers (IQR)"][0]
    assert out["severity"] == "warning"           # exactly 10 % is not critical
    sk = [a for a in al if a["issue"] == "High skewness"][0]
    assert sk["value"] == pytest.approx(3.118896, abs=1e-4)   # value column carries 4 places


def test_f4_guards(spark):
    rows = [(1.0, 1.0, None if i < 3 else 1.0, float(i) if i < 3 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "iqr0 double, c double, m30 double, few double")
    issues = {(a["column"], a["issue"]) for a in AL.alerts(df).collect()}
    assert not any(c == "iqr0" and i.startswith(("Outliers", "High skew")) for c, i in issues)
    assert ("m30", "Missing values") in issues          # exactly 30 % -> warning
    assert ("few", "High missing %") in issues           # 70 % missing
    assert not any(c == "few" and i.startswith("Outliers") for c, i in issues)  # 3 values only
    five = spark.createDataFrame([(None if i == 0 else float(i),) for i in range(20)], "v double")
    assert AL.alerts(five).count() == 0                  # 5 % exactly -> no alert


def test_f5_empty_and_degenerate(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert P.quality_score(empty).first()["quality"] == 0.0
    const = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, x double")
    r = {(x["a"], x["b"]): x["r"] for x in correlation(const).collect()}
    assert r[("c", "x")] is None
    assert B.histogram(const, "c").count() == 1
    allnull = spark.createDataFrame([(None, 1), (None, 2)], "a double, k int")
    assert [x["a"] for x in C.fill_missing(allnull, "a", "mode").collect()] == [None, None]
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "a double")
    m = {x["column"]: x for x in P.missing_counts(nan).collect()}
    assert m["a"]["missing"] == 2
    spaced = spark.createDataFrame([(1.0, 2.0)], "`my col` double, b double")
    assert K.add_column(spaced, "s", "`my col` + b").first()["s"] == 3.0
    neg = spark.createDataFrame([(float(i), float(i) - 2) for i in range(6)], "x double, y double")
    assert T.trendline(neg, "x", "y", "exponential").first()["coefficients"] is None
    three = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    assert T.trendline(three, "x", "y", "linear").first()["coefficients"] is None


def test_f5_total_key_in_pivot(spark):
    df = spark.createDataFrame([("Total", 1.0), ("a", 2.0)], "r string, v double")
    rows = [tuple(x) for x in pivot(df, ["r"], [], ["v"], "sum").collect()]
    assert rows == [("Total", 1.0), ("a", 2.0), ("Total", 3.0)]


def test_one_row(spark):
    one = spark.createDataFrame([(5.0,)], "v double")
    d = P.describe(one).first()
    assert (d["count"], d["mean"], d["std"], d["p50"]) == (1, 5.0, None, 5.0)
    assert math.isclose(B.histogram(one, "v").first()["lower"], 5.0)
    assert F is not None
