"""NaN beside NULL, CSV with real text, chart data without caps."""

import math

import pytest

from quarry.functions.quantiles import quantiles_long
from quarry.operators import aggregate as A
from quarry.operators import bins as B
from quarry.operators import clean as C
from quarry.operators import profile as P
from quarry.operators import windows as W
from quarry.operators.pivot import pivot
from quarry.plans import spec as S
from quarry.sources.io import read_csv, write_csv

NAN = float("nan")


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(1, "a", 1.0, 2.0), (2, "a", NAN, 3.0), (3, "a", None, 5.0), (4, "b", 4.0, NAN), (5, "b", 6.0, 7.0),
            (6, "b", 9.0, 8.0)]
    return spark.createDataFrame(rows, "i int, g string, v double, w double")


def test_nan_is_missing(spark, holes):
    got = {r.g: r.v for r in A.group_agg(holes, "g", "v", "sum").collect()}
    assert got == {"a": 1.0, "b": 19.0}
    assert {r.g: r.v for r in A.group_agg(holes, "g", "v", "count").collect()} == {"a": 1, "b": 3}
    assert sum(r["count"] for r in A.value_counts(holes, "v").collect()) == 4
    r = [x for x in A.correlation(holes, ["v", "w"]).collect()]
    assert all(not (isinstance(c, float) and math.isnan(c)) for x in r for c in x)
    cells = [c for x in pivot(holes, ["g"], [], ["v"], "sum").collect() for c in x]
    assert not any(isinstance(c, float) and math.isnan(c) for c in cells)
    same = spark.createDataFrame([(1, NAN), (1, None), (2, 1.0)], "a int, b double")
    assert C.drop_duplicates(same).count() == 2
    assert P.duplicate_count(same).first()[0] == 1
    means = [c for x in W.rolling_mean(holes, "v", ["i"], 2).collect() for c in x]
    assert not any(isinstance(c, float) and math.isnan(c) for c in means)


def test_csv_keeps_text(spark, tmp_path):
    rows = [(1, 'he said ""hi"", ok', "12:30", None), (2, "  lead\nand break\n", "08:15", None), (3, 'a,"b"\\', "00:00", None)]
    df = spark.createDataFrame(rows, "i bigint, t string, at string, none string")
    write_csv(df, str(tmp_path / "x"))
    got = read_csv(spark, str(tmp_path / "x"))
    assert dict(got.dtypes) == {"i": "bigint", "t": "string", "at": "string", "none": "double"}
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_chart_data_is_whole(spark):
    df = spark.createDataFrame([(i, f"c{i % 30:02d}", float(i), float(i * 2 + i % 3)) for i in range(6000)],
                               "i int, c string, x double, y double")
    spec = lambda k, **kw: S.run_spec(df, {"chart_type": k, **kw})
    assert spec("Treemap", x_col="c").count() == 30
    assert spec("Pie", x_col="c", y_col="x").count() == 30
    assert spec("Pie", x_col="c").count() == 10 and spec("Pie Chart", x_col="c").count() == 12
    assert spec("Scatter", x_col="x", y_col="y").count() == 6000
    assert spec("Scatter", x_col="x", y_col="y").columns == ["x", "y", "fit"]
    for kind in ("Pair Plot", "Parallel Coordinates", "3D Scatter"):
        assert spec(kind).count() == 6000
    assert spec("Strip Plot", x_col="c", y_col="x").count() == 6000
    assert spec("Histogram", x_col="c").count() == 30
    assert B.points(df, ["x"], None, 100).count() == 100
    assert B.points(df, ["x"], "c", 7).count() == 210


def test_quantiles_do_not_shuffle_rows_by_group(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        df = spark.range(100_000).selectExpr("id % 3 as g", "cast(id as double) as v")
        plan = quantiles_long(df, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastHashJoin [g" in plan
        med = C.fill_missing(df, "v", "median")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in med
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_alerts_of_an_empty_table(holes):
    from quarry.operators.alerts import alerts, recommend
    assert alerts(holes.limit(0)).collect() is not None
    assert recommend(holes.limit(0)).collect() is not None
