"""Column edits: drop, rename, cast, calculated columns, projections for point charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import date_formats, parse_dates
from quarry.functions.exprs import check_columns, col, nan_as_missing, numeric_columns

# Target types of the cast request.
CAST_TYPES = ("datetime", "int64", "float64", "str", "category")


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; every name must exist (Spark alone would ignore unknown names)."""
    check_columns(df, cols)
    return df.drop(*cols)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column; the old name must exist and the new one must be free."""
    check_columns(df, [old])
    if new in df.columns:
        raise ValueError(f"Column '{new}' already exists.")
    return df.withColumnRenamed(old, new)


def _to_long(c: Column) -> Column:
    """Text/number -> bigint: whole-number text keeps all digits; otherwise through double."""
    return F.coalesce(c.cast("string").try_cast("bigint"),
                      c.cast("string").try_cast("double").try_cast("bigint"))


def cast_column(df: DataFrame, c: str, new_type: str, formats: Sequence[str] | None = None,
                allow_fraction: bool = False, day_first: bool | None = None) -> DataFrame:
    """Cast with coercion: values that do not parse become NULL.

    ``int64`` refuses values with a fraction (pandas raises "cannot safely cast") unless
    ``allow_fraction`` truncates them; that check is one ``count_if`` job. ``datetime``
    tries ISO first, then each of ``formats``; without them, formats of a text column are read from
    its cells in one job (``functions.dates``; ValueError where day and month cannot be told apart
    and ``day_first`` is not given). A time of day alone has no date and becomes NULL unless a format
    takes it. ``str`` keeps missing as NULL.
    """
    check_columns(df, [c])
    if new_type not in CAST_TYPES:
        raise ValueError(f"unknown type {new_type!r}; expected one of {CAST_TYPES}")
    x = col(c)
    if new_type == "datetime":
        s = x.cast("string")
        iso = F.when(~s.rlike(r"^\s*T?\d{1,2}:"), F.try_to_timestamp(s))
        given = [F.try_to_timestamp(s, F.lit(f)) for f in formats or ()]
        if formats is None and df.schema[c].dataType.typeName() == "string":
            given = [parse_dates(x, found)] if (found := date_formats(df, c, day_first)) else []
        out = F.coalesce(iso, *given)
    elif new_type == "int64":
        if not allow_fraction:
            d = x.cast("string").try_cast("double")
            bad = df.select(F.count_if(d.isNotNull() & ~F.isnan(d) & (d != F.floor(d)))
                            .alias("n")).first()["n"]
            if bad:
                raise ValueError(f"cannot safely cast {c} to int64: {bad} values have a fraction")
        out = _to_long(x)
    elif new_type == "float64":
        out = x.cast("string").try_cast("double")
    else:  # str, category
        out = x.cast("string")
    return df.select(*[out.alias(y) if y == c else col(y) for y in df.columns])


def category_codes(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Category codes 0..k-1 in sorted value order (missing -> -1), as pandas' ``cat.codes``.

    The distinct values are ranked once (a small table) and joined back by value."""
    check_columns(df, [c])
    name = name or f"{c}_code"
    from quarry.operators.windows import ordered_index
    vals = df.select(col(c).cast("string").alias("_val")).where(F.col("_val").isNotNull()) \
             .distinct()
    codes = ordered_index(vals, ["_val"], name="_code")
    j = df.join(codes, col(c).cast("string") == F.col("_val"), "left")
    return j.select(*[col(y) for y in df.columns],
                    F.coalesce(F.col("_code"), F.lit(-1)).alias(name))


def add_column(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """Calculated column from a Spark SQL expression (back-ticks quote names with spaces) or
    a Column; the name must be new."""
    if name in df.columns:
        raise ValueError(f"Column '{name}' already exists.")
    e = F.expr(expr) if isinstance(expr, str) else expr
    return df.withColumn(name, e)


def numeric_projection(df: DataFrame, k: int, color: str | None = None) -> DataFrame:
    """First k numeric columns plus an optional colour column (pair plot 5, parallel
    coordinates 8, 3-D scatter 3)."""
    check_columns(df, [color])
    num = numeric_columns(df)[:k]
    return df.select(*[col(c) for c in num], *([col(color)] if color else []))


@nan_as_missing
def map_points(df: DataFrame, lat: str, lon: str, hover: str | None = None,
               size: str | None = None, grid: float | None = None) -> DataFrame:
    """Rows with both coordinates (plus label/size columns). With ``grid`` (degrees) the
    points are binned to cells with counts and summed size, so the output stays drawable."""
    check_columns(df, [lat, lon, hover, size])
    base = df.dropna(subset=[lat, lon])
    if grid is None:
        keep = [lat, lon] + [c for c in (hover, size) if c]
        return base.select(*[col(c) for c in dict.fromkeys(keep)])
    cell_lat = (F.floor(col(lat) / grid) * grid).alias("cell_lat")
    cell_lon = (F.floor(col(lon) / grid) * grid).alias("cell_lon")
    aggs = [F.count(F.lit(1)).alias("points")]
    if size:
        aggs.append(F.coalesce(F.sum(col(size)), F.lit(0)).alias("size"))
    return base.groupBy(cell_lat, cell_lon).agg(*aggs)


@nan_as_missing
def choropleth(df: DataFrame, iso: str, value: str, agg: str | None = None) -> DataFrame:
    """Rows with an area code and a value; with ``agg`` one row per code."""
    check_columns(df, [iso, value])
    base = df.dropna(subset=[iso, value])
    if agg is None:
        return base.select(col(iso), col(value))
    from quarry.operators.aggregate import group_agg
    return group_agg(base, iso, value, agg)
