"""Line and area charts draw every row, samples keep their bounds at any size, times of day are no dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import bins as B
from quarry.operators.columns import cast_column
from quarry.plans import spec as S


@pytest.fixture(scope="module")
def rows(spark):
    data = [(3, "b", 1.0), (1, "a", 2.0), (1, "a", 5.0), (1, "b", None), (1, "b", 4.0), (2, None, 3.0), (None, "a", 6.0), (2, "a", 1.5)]
    return spark.createDataFrame(data, "x int, c string, y double")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_line_is_every_row_in_order(rows):
    out = S.run_spec(rows, {"chart_type": "Line", "x_col": "x", "y_col": "y", "aggregation": "mean"})
    assert got(out) == got(rows.select("x", "y"))
    xs = [r.x for r in out.collect() if r.x is not None]
    assert xs == sorted(xs)
    out = S.run_spec(rows, {"chart_type": "Line Chart", "x_col": "x", "y_col": "y", "color_by": "c"})
    assert out.columns == ["x", "c", "y"] and out.count() == 8


def test_only_a_top_n_is_aggregated(rows):
    for kind in ("Line", "Area"):
        out = S.run_spec(rows, {"chart_type": kind, "x_col": "x", "y_col": "y", "top_n": 2})
        assert [tuple(r) for r in out.collect()] == [(1, 11.0), (2, 4.5)]


def test_area_is_every_row_on_the_colours_before(rows):
    out = S.run_spec(rows, {"chart_type": "Area", "x_col": "x", "y_col": "y"})
    assert got(out) == got(rows.select("x", "y"))
    out = S.run_spec(rows, {"chart_type": "Area", "x_col": "x", "y_col": "y", "color_by": "c"})
    assert out.columns == ["x", "c", "y", "stacked"]
    assert got(out) == sorted([(3, "b", 1.0, 1.0), (1, "a", 2.0, 2.0), (1, "a", 5.0, 5.0), (1, "b", None, None), (1, "b", 4.0, 11.0),
                               (2, None, 3.0, 3.0), (None, "a", 6.0, 6.0), (2, "a", 1.5, 4.5)], key=repr)


def test_time_of_day_is_no_date(spark):
    df = spark.createDataFrame([("12:30",), (" 8:15:01",), ("T09:00",), ("2024-01-05 12:30:00",), ("2024-01-05",), ("x",), (None,)], "t string")
    day = dt.datetime(2024, 1, 5)
    assert [r.t for r in cast_column(df, "t", "datetime").collect()] == [None, None, None, day.replace(hour=12, minute=30), day, None, None]
    assert cast_column(df.limit(1), "t", "datetime", ["HH:mm"]).first().t.hour == 12


def test_large_samples_do_not_gather_a_colour(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("c").alias("c"), (F.col("id") % 20_000).alias("x"))
    out = B.points(df, ["x"], "c", 5000)
    assert out.groupBy("c").count().orderBy("c").collect()[0][:] == ("c", 5000) and out.count() == 10_000
    first = sorted(map(tuple, out.collect()))
    assert first == sorted(map(tuple, B.points(df.repartition(3), ["x"], "c", 5000).collect()))
    # What reaches a colour's own task is what the parts kept, never the whole colour.
    parts = df.withColumn("p", F.monotonically_increasing_id() % B.POINT_PARTS).groupBy("c", "p").count()
    assert parts.agg(F.max("count")).first()[0] < 20_000 / B.POINT_PARTS * 2
