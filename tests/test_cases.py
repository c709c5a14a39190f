"""Edge cases of the reworked operators: helper names, typed pivot keys, outliers, layouts, plans."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.operators import alerts as AL
from quarry.operators import bins as B
from quarry.operators import clean as C
from quarry.operators import fit as T
from quarry.operators import pivot as PV
from quarry.operators import profile as P
from quarry.operators import windows as W


def test_helper_names_keep_user_columns(spark):
    df = spark.createDataFrame([("x1", 1, 1.0, "p"), ("x2", 2, None, "q"), ("x3", 3, None, "r")],
                               "_id string, i int, v double, _pid string")
    out = W.forward_fill(df, "v", ["i"]).orderBy("i").collect()
    assert [(r["_id"], r["v"], r["_pid"]) for r in out] == [("x1", 1.0, "p"), ("x2", 1.0, "q"), ("x3", 1.0, "r")]
    idx = W.ordered_index(df, ["i"], name="_at").orderBy("i").collect()
    assert [(r["_id"], r["_at"]) for r in idx] == [("x1", 0), ("x2", 1), ("x3", 2)]


def test_cleaning_keeps_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(float(i), i, -i) for i in range(20)] + [(1e6, 20, -20), (None, 21, -21)],
                               "v double, lower int, _fill int")
    assert [(r["lower"], r["_fill"]) for r in C.outliers(df, "v").collect()] == [(20, -20)]
    assert [r["_fill"] for r in C.fill_missing(df, "v", "mode").where("lower = 21").collect()] == [-21]


def test_ordered_index_counts_missing_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, i int").repartition(5)
    out = {(r["g"], r["i"]): r["row_index"] for r in W.ordered_index(df, ["i"], ["g"]).collect()}
    assert out == {(None, 1): 0, (None, 2): 1, ("a", 1): 0}


def test_fill_and_rolling_over_many_partitions(spark):
    n = 3000
    pdf = pd.DataFrame({"i": range(n), "g": [i * 7 % 3 for i in range(n)],
                        "v": [float(i) if i % 11 == 0 else None for i in range(n)]})
    df = spark.createDataFrame(pdf).repartition(7)
    filled = W.forward_fill(df, "v", ["i"], ["g"]).orderBy("i").toPandas()["v"]
    want = pdf.groupby("g")["v"].ffill()
    assert filled.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_rolling_mean_time_matches_pandas(spark):
    ts = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:30", "2024-01-01 00:01:00",
                         "2024-01-01 00:05:00", "2024-01-01 02:00:00"])
    pdf = pd.DataFrame({"ts": ts, "v": [1.0, 2.0, None, 4.0, 5.0]})
    df = spark.createDataFrame(pdf)
    got = W.rolling_mean_time(df, "v", "ts", 60, name="m", spans=1).orderBy("ts").toPandas()["m"]
    want = pdf.set_index("ts")["v"].rolling("60s", min_periods=1).mean()
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()
    none = df.where("v > 99")
    assert W.rolling_mean_time(none, "v", "ts", 60).count() == 0


def test_pivot_typed_and_clashing_keys(spark):
    df = spark.createDataFrame([("r", True, 1.0), ("r", False, 2.0)], "a string, b boolean, v double")
    row = PV.pivot(df, ["a"], ["b"], ["v"]).first().asDict()
    assert row == {"a": "r", "False": 2.0, "True": 1.0, "Total": 3.0}
    given = PV.pivot(df, ["a"], ["b"], ["v"], column_values=[True]).first().asDict()
    assert given == {"a": "r", "True": 1.0, "Total": 3.0}
    df = spark.createDataFrame([("r", "a_b", "c", 1.0), ("r", "a", "b_c", 2.0)],
                               "a string, k string, l string, v double")
    row = PV.pivot(df, ["a"], ["k", "l"], ["v"]).first().asDict()
    assert row == {"a": "r", "a_b_c": 2.0, "a_b_c (2)": 1.0, "Total": 3.0}
    assert PV.pivot(df.where("v > 9"), ["a"], ["k"], ["v"]).count() == 0


def test_pivot_refuses_more_columns_than_spark(spark):
    df = spark.range(30).select(F.lit("r").alias("a"), "id", F.lit(1.0).alias("v"))
    old = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "20")
    try:
        with pytest.raises(ValueError, match="long form"):
            PV.pivot(df, ["a"], ["id"], ["v"])
        with pytest.raises(ValueError, match="long form"):
            A.crosstab(df, "a", "id")
        assert PV.pivot_long(df, ["a"], ["id"], ["v"]).count() == 62
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", old)


def test_violin_integrates_to_one_with_an_outlier(spark):
    df = spark.range(1000).select((F.col("id") / 1000.0).alias("y")) \
        .unionByName(spark.createDataFrame([(1e6,)], "y double"))
    out = B.violin(df, "y").toPandas()
    step = out["y"].diff().min()
    assert math.isclose(out["density"].sum() * step, 1.0, rel_tol=0.01)
    assert len(out) < 1000
    same = B.violin(spark.createDataFrame([(2.0,)] * 5, "y double"), "y", box=True).toPandas()
    assert same["median"].eq(2.0).all() and len(same) > 0


def test_kmeans_is_the_same_for_every_layout(spark):
    df = spark.range(900).select(F.col("id"), ((F.col("id") * 37) % 101).cast("double").alias("a"),
                                 ((F.col("id") * 53) % 97).cast("double").alias("b"))
    one = T.kmeans(df.coalesce(1), ["a", "b"], k=4)
    two = T.kmeans(df.repartition(7), ["a", "b"], k=4)
    assert one.select("id", "Cluster").exceptAll(two.select("id", "Cluster")).count() == 0
    # every row is at its nearest centre
    pdf = one.toPandas()
    z = (pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)
    centres = z.groupby(pdf["Cluster"]).mean()
    dist = pd.DataFrame({c: ((z - m) ** 2).sum(axis=1) for c, m in centres.iterrows()})
    own = pd.Series([dist.loc[i, c] for i, c in pdf["Cluster"].items()])
    assert (own - dist.min(axis=1)).max() < 0.1
    with pytest.raises(ValueError, match="settled"):
        T.kmeans(df, ["a", "b"], k=4, max_iter=1)
    assert T.kmeans(df.where("id < 0"), ["a", "b"]).count() == 0
    assert T.kmeans(df.where("id < 1"), ["a", "b"]).first()["Cluster"] == "C1"


def test_central_of_text_and_all_missing(spark):
    t = P.central(spark.createDataFrame([("a",), ("b",), ("b",)], "t string"), "t").first()
    assert (t["mean"], t["median"], t["mode"]) == (None, None, "b")
    m = P.central(spark.createDataFrame([(None,)], "v double"), "v").collect()
    assert len(m) == 1 and m[0]["mode"] is None


def test_recommend_and_profile_with_a_map_and_long_text(spark):
    df = spark.createDataFrame([({"a": 1}, "x" * 50_000, -0.0), ({"a": 2}, "x" * 50_000, 0.0), (None, "y", None)],
                               "m map<string,int>, t string, v double")
    got = {r["column"]: r["unique"] for r in P.profile(df).collect()}
    assert got == {"m": None, "t": 2, "v": 1}
    assert {r["column"] for r in AL.recommend(df).collect()} == {"m", "t", "v"}
    assert P.profile(df.limit(0)).count() == 3


def _shuffled_rows(df) -> list[int]:
    """Records written by each shuffle of the executed plan."""
    df.collect()
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        assert name != "CartesianProductExec"
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_rows_are_not_shuffled_by_group(spark):
    """With a low broadcast limit, rows are still not shuffled by group nor multiplied."""
    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).cast("double").alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        for out in (P.describe(df), B.box_stats(df, "v", "g"), A.group_agg(df, "g", "v", "median"),
                    C.fill_missing(df, "v", "median"), AL.alerts(df),
                    PV.pivot(df, ["g"], ["g"], ["v"], "median").limit(10)):
            assert max(_shuffled_rows(out), default=0) < 20_000
        # the measure sees a shuffle of rows
        assert max(_shuffled_rows(df.repartition(5, "g"))) == 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
