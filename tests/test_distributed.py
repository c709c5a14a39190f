"""The distributed building blocks against pandas / NumPy on data that forces every path:
approximate slices (small accuracy), ties, groups, many sort partitions, tiny chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions.quantiles import quantiles_long
from quarry.operators import windows as W


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 20000
    pdf = pd.DataFrame({
        "i": np.arange(n),
        "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),   # one hot group
        "v": np.round(rng.gamma(2.0, 10.0, n), 1),                # many ties
    })
    pdf.loc[rng.choice(n, 3000, replace=False), "v"] = np.nan
    sdf = spark.createDataFrame(pdf.assign(v=pdf.v.astype(object).where(pdf.v.notna(), None)),
                                "i long, g string, v double").repartition(7)
    return pdf, sdf


@pytest.mark.parametrize("accuracy,buckets", [(50, 4), (50, 1024), (10000, 3), (10000, 1024)])
def test_quantiles_exact(data, accuracy, buckets):
    pdf, sdf = data
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = quantiles_long(sdf, ["g"], "v", ps, accuracy=accuracy, buckets=buckets).collect()
    for r in got:
        expected = pdf[pdf.g == r["g"]].v.dropna().quantile(r["p"])
        assert r["q"] == pytest.approx(expected, rel=1e-12, abs=1e-9), (r, expected)
    assert len(got) == 3 * len(ps)


def test_forward_fill_matches_pandas(data, spark):
    pdf, sdf = data
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = W.forward_fill(sdf, "v", ["i"]).orderBy("i").toPandas()
        by = W.forward_fill(sdf, "v", ["i"], ["g"]).orderBy("i").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    exp = pdf.sort_values("i").v.ffill()
    assert np.allclose(got.v.values, exp.values, equal_nan=True)
    exp_by = pdf.sort_values("i").groupby("g").v.ffill()
    assert np.allclose(by.v.values, exp_by.values, equal_nan=True)


def test_rolling_mean_matches_pandas(data):
    pdf, sdf = data
    got = W.rolling_mean(sdf, "v", ["i"], 5, chunk=37, name="r").orderBy("i").toPandas()
    exp = pdf.sort_values("i").v.rolling(5).mean()
    assert np.allclose(got.r.values, exp.values, equal_nan=True)
    got2 = W.rolling_mean(sdf, "v", ["i"], 4, ["g"], min_periods=2, chunk=11, name="r") \
        .orderBy("i").toPandas()
    exp2 = pdf.sort_values("i").groupby("g").v.rolling(4, min_periods=2).mean() \
        .reset_index(level=0, drop=True).sort_index()
    assert np.allclose(got2.r.values, exp2.values, equal_nan=True)


def test_ordered_index(data):
    _, sdf = data
    idx = W.ordered_index(sdf, ["v", "i"], ["g"], name="k")
    bad = idx.groupBy("g").agg(F.count("*").alias("n"), F.min("k").alias("lo"),
                               F.max("k").alias("hi"), F.countDistinct("k").alias("d")) \
             .where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)
                    | (F.col("d") != F.col("n")))
    assert bad.count() == 0


def test_points_sample_is_bounded_and_repeatable(data):
    from quarry.operators.bins import points
    _, sdf = data
    a = points(sdf, ["i", "v"], "g", max_points=100, key=["i"])
    sizes = {r["g"]: r["count"] for r in a.groupBy("g").count().collect()}
    assert sizes == {"a": 100, "b": 100, "c": 100}
    b = points(sdf, ["i", "v"], "g", max_points=100, key=["i"])
    assert sorted(r["i"] for r in a.collect()) == sorted(r["i"] for r in b.collect())
