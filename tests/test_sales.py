"""Expected values on the reference's Sales sample (computed with pandas, FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from fixtures import sales
from quarry.operators import aggregate as A
from quarry.operators import fit as T
from quarry.operators import profile as P
from quarry.operators.pivot import pivot


@pytest.fixture(scope="module")
def df(spark):
    return sales(spark)


def test_group_by_region(df):
    got = {}
    for agg in ("sum", "mean", "count", "min", "max", "median"):
        for r in A.group_agg(df, "Region", "Sales", agg).collect():
            got.setdefault(r["Region"], []).append(r["Sales"])
    assert got["North"] == pytest.approx([113500, 18916.666667, 6, 12000, 25000, 20500])
    assert got["South"] == pytest.approx([121500, 20250, 6, 15000, 28000, 18750])


def test_value_counts(df):
    assert [tuple(r) for r in A.value_counts(df, "Category").collect()] == \
        [("A", 5), ("B", 4), ("C", 3)]


def test_describe(df):
    rows = {r["column"]: r for r in P.describe(df, ["Sales", "Profit"]).collect()}
    s, p = rows["Sales"], rows["Profit"]
    assert (s["count"], s["mean"], s["std"], s["min"], s["p25"], s["p50"], s["p75"], s["max"]) == \
        (12, 19583.33, 4790.30, 12000, 16500, 19750, 22500, 28000)
    assert (p["mean"], p["std"], p["p25"], p["p50"], p["p75"]) == (4675.0, 1591.53, 3725, 4650, 5425)


def test_correlation(df):
    r = {(x["a"], x["b"]): x["r"] for x in A.correlation(df, ["Sales", "Profit"]).collect()}
    assert r[("Sales", "Profit")] == pytest.approx(0.994184, abs=1e-6)
    assert r[("Profit", "Sales")] == r[("Sales", "Profit")]
    assert r[("Sales", "Sales")] == pytest.approx(1.0)


def test_linear_fit(df):
    f = T.trendline(df, "Sales", "Profit", "linear").first()
    assert f["coefficients"][0] == pytest.approx(0.330307032, rel=1e-8)
    assert f["coefficients"][1] == pytest.approx(-1793.51271, rel=1e-8)
    assert f["r2"] == 0.9884


def test_exponential_fit(df):
    f = T.trendline(df, "Sales", "Profit", "exponential").first()
    assert f["coefficients"][0] == pytest.approx(1054.407371, rel=1e-8)
    assert f["coefficients"][1] == pytest.approx(7.322723514e-05, rel=1e-8)
    assert f["r2"] == 0.9877


def test_polynomial_matches_polyfit(df):
    import numpy as np
    x = np.array(sales_col("Sales"), float)
    y = np.array(sales_col("Profit"), float)
    for d in (2, 3, 5):
        f = T.trendline(df, "Sales", "Profit", "polynomial", degree=d).first()
        expected = np.polyfit(x, y, d)
        fitted_ours = np.polyval(f["coefficients"], x)
        assert np.allclose(fitted_ours, np.polyval(expected, x), rtol=1e-6)
        r2 = 1 - np.sum((y - np.polyval(expected, x)) ** 2) / np.sum((y - y.mean()) ** 2)
        assert f["r2"] == round(float(r2), 4)


def sales_col(name):
    from fixtures import SALES
    return SALES[name]


def test_skew_kurtosis(df):
    m = {r["column"]: r for r in P.moments(df, ["Sales"]).collect()}["Sales"]
    assert m["skew"] == pytest.approx(0.0790361433, abs=1e-9)
    assert m["kurtosis"] == pytest.approx(-0.6019289926, abs=1e-9)


def test_pivot_with_totals(df):
    rows = {r["Region"]: tuple(r[1:]) for r in
            pivot(df, ["Region"], ["Category"], ["Sales"], "sum").collect()}
    assert rows == {"North": (45500, 46000, 22000, 113500), "South": (47500, 39000, 35000, 121500),
                    "Total": (93000, 85000, 57000, 235000)}


def test_crosstab(df):
    rows = {r["Region"]: tuple(r[1:]) for r in A.crosstab(df, "Region", "Category").collect()}
    assert rows == {"North": (3, 2, 1), "South": (2, 2, 2)}


def test_shares_add_to_one(df):
    assert sum(r["share"] for r in A.shares(df, "Category").collect()) == pytest.approx(1.0)


def test_top_n(df):
    out = A.top_n(df, "Month", "Sales", "sum", 3).collect()
    assert [r["Month"] for r in out] == ["Dec", "Nov", "Aug"]
    assert "TakeOrderedAndProject" in A.top_n(df, "Month", "Sales", "sum", 3) \
        ._jdf.queryExecution().executedPlan().toString()


def test_kmeans_invariants(df):
    lab = T.kmeans(df, ["Sales", "Profit", "Customers"], k=3)
    sizes = T.cluster_sizes(lab).collect()
    assert sum(r["Count"] for r in sizes) == 12
    assert {r["Cluster"] for r in sizes} == {"C1", "C2", "C3"}
    # same data, same labels
    lab2 = T.kmeans(df, ["Sales", "Profit", "Customers"], k=3)
    a = sorted((r["Month"], r["Cluster"]) for r in lab.collect())
    b = sorted((r["Month"], r["Cluster"]) for r in lab2.collect())
    assert a == b
    means = T.cluster_means(lab, ["Sales"]).collect()
    assert len(means) == 3 and all(r["Sales"] is not None for r in means)


def test_standardize(df):
    z = T.standardize(df, ["Sales"]).agg(F.avg("Sales").alias("m"),
                                         F.stddev_pop("Sales").alias("s")).first()
    assert z["m"] == pytest.approx(0, abs=1e-12) and z["s"] == pytest.approx(1)
