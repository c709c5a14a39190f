"""Datetime casts whose formats are read from the cells."""

import datetime as dt

import pytest

from quarry.functions import dates
from quarry.operators.columns import cast_column


def cast(spark, cells, **kw):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, `the date` string")
    return [r[1] for r in cast_column(df, "the date", "datetime", **kw).orderBy("i").collect()]


def d(*a):
    return dt.datetime(*a)


def test_month_names(spark):
    cells = ["Jan 5, 2024", "  may  6 2024 ", "September 30, 2023 4:05 PM", "5 March 2020", "07-DEC-1999 23:59:58",
             "Feb 30, 2024", "Smarch 1, 2024", "Jan 5, 24", None, "", "12:30"]
    assert cast(spark, cells) == [d(2024, 1, 5), d(2024, 5, 6), d(2023, 9, 30, 16, 5), d(2020, 3, 5),
                                  d(1999, 12, 7, 23, 59, 58), None, None, None, None, None, None]


def test_order_is_told_by_numbers_above_twelve(spark):
    assert cast(spark, ["05.01.2024", "13.01.2024", "2024-03-04", "31.12.2023 08:15"]) == [
        d(2024, 1, 5), d(2024, 1, 13), d(2024, 3, 4), d(2023, 12, 31, 8, 15)]
    assert cast(spark, ["05/01/2024", "1/13/2024"]) == [d(2024, 5, 1), d(2024, 1, 13)]
    # each separator by itself, the time of day does not matter
    assert cast(spark, ["13.01.2024 10:00", "05.01.2024", "1/13/2024", "05/01/2024"]) == [
        d(2024, 1, 13, 10), d(2024, 1, 5), d(2024, 1, 13), d(2024, 5, 1)]


def test_order_that_cannot_be_told_is_refused(spark):
    for cells in (["05.01.2024", "06.02.2024"], ["13/01/2024", "01/13/2024"]):
        with pytest.raises(ValueError, match="day_first"):
            cast(spark, cells)
    assert cast(spark, ["05.01.2024"], day_first=True) == [d(2024, 1, 5)]
    assert cast(spark, ["05.01.2024"], day_first=False) == [d(2024, 5, 1)]
    assert cast(spark, ["13/01/2024", "01/13/2024"], day_first=True) == [d(2024, 1, 13), None]


def test_given_formats_hold_alone(spark):
    assert cast(spark, ["05.01.2024"], formats=["dd.MM.yyyy"]) == [d(2024, 1, 5)]
    assert cast(spark, ["05.01.2024"], formats=()) == [None]


def test_year_first_and_shapes_are_bounded(spark):
    assert cast(spark, ["2024/1/5", "2024.12.31 1:02:03"]) == [d(2024, 1, 5), d(2024, 12, 31, 1, 2, 3)]
    df = spark.range(500).selectExpr("concat('note ', id, ' of 2024') AS x")
    assert dates.date_shapes(df, "x").count() == 0
    assert cast(spark, []) == []
