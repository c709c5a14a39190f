"""Duplicates by row digests: equal exactly where all cells are, and narrow in the shuffle."""

import datetime as dt
import re

from pyspark.sql import functions as F

from quarry.operators import profile


def count(df):
    return profile.duplicate_count(df).first()["duplicates"]


def plain(df):
    """Rows less distinct rows, by grouping whole rows."""
    groups = df.groupBy(*[f"`{c}`" for c in df.columns]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def test_neighbouring_cells_do_not_run_together(spark):
    rows = [("ab", "c"), ("a", "bc"), ("", "abc"), (None, "abc"), ("abc", None), ("abc", ""), ("1:a", ""), ("", "1:a"),
            ("-:", None), (None, "-:"), (None, None), ("", ""), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert count(df) == 0
    assert count(df.unionByName(df)) == len(rows)


def test_all_types_against_whole_rows(spark):
    t = dt.datetime(2024, 10, 27, 1, 30)
    rows = [(1, 1.0, "x", True, dt.date(2024, 1, 1), t, bytearray(b"\x00"), [1, None], (1, "a")),
            (1, 1.0, "x", True, dt.date(2024, 1, 1), t, bytearray(b"\x00"), [1, None], (1, "a")),
            (1, 1.0, "x", True, dt.date(2024, 1, 1), t, bytearray(b"\x00"), [None, 1], (1, "a")),
            (1, 1.0, "x", True, dt.date(2024, 1, 1), t + dt.timedelta(microseconds=1), bytearray(b"\x00"), [1, None],
             (1, "a")),
            (1, 1.0, "x", True, dt.date(2024, 1, 1), t, bytearray(b""), [1, None], (1, "a")),
            (1, 1.0, "x", True, dt.date(2024, 1, 1), t, bytearray(b"\x00"), [1, None], (None, "a")),
            (None,) * 9, (None,) * 9]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean, day date, t timestamp, raw binary, "
                                     "a array<int>, st struct<x:int,y:string>")
    assert count(df) == plain(df) == 2


def test_zero_signs_nan_and_odd_names(spark):
    df = spark.createDataFrame([(0.0, "p"), (-0.0, "p"), (float("nan"), "q"), (None, "q"), (float("nan"), "r")],
                               "`a.b` double, _digest string")
    assert count(df) == 2           # the two zeros; NaN and NULL are both missing


def test_empty_tables(spark):
    assert count(spark.createDataFrame([], "a int, b string")) == 0
    assert count(spark.range(3).select()) == 0


def test_shuffle_does_not_carry_texts(spark):
    df = spark.range(400).select("id", F.repeat(F.col("id").cast("string"), 2000).alias("text"))
    plan = profile.duplicate_count(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k0#\d+", plan)
    assert not re.search(r"hashpartitioning\([^)]*text", plan)
