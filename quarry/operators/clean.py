"""Cleaning: missing-value normalisation, row drops, imputation, duplicates, outlier fences.

Imputation statistics are computed once as a one-row DataFrame and cross-joined as a
broadcast (one row: bounded by construction); the fill itself is a projection, so it runs
inside the same whole-stage-codegen span as the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import (FRACTIONAL_TYPES, NUMERIC_TYPES, check_columns, col, free_names, nan_as_missing,
                                    nan_to_null, numeric_columns)
from quarry.functions.quantiles import quantiles_long, stack_columns
from quarry.operators.profile import mode_value

# Strategies of the fill request.
FILL_STRATEGIES = ("mean", "median", "mode", "ffill", "drop", "constant")


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float/double column (so Spark's NULL rules match ``isna``)."""
    return df.select(*[nan_to_null(col(f.name)).cast(f.dataType).alias(f.name)
                       if isinstance(f.dataType, FRACTIONAL_TYPES) else col(f.name)
                       for f in df.schema.fields])


def drop_missing(df: DataFrame, c: str) -> DataFrame:
    """Drop rows whose ``c`` is missing (NULL or NaN)."""
    check_columns(df, [c])
    return df.dropna(subset=[c])


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows complete in all of ``cols``."""
    check_columns(df, cols)
    return df.dropna(subset=list(cols))


def _with_fill(df: DataFrame, c: str, stat: DataFrame, out_type: T.DataType) -> DataFrame:
    fill, = free_names(df, "fill")
    filled = F.coalesce(nan_to_null(col(c)) if isinstance(df.schema[c].dataType, FRACTIONAL_TYPES)
                        else col(c), F.col(fill).cast(out_type)).cast(out_type)
    return (df.crossJoin(F.broadcast(stat.select(F.col(stat.columns[0]).alias(fill))))
            .select(*[filled.alias(x) if x == c else col(x) for x in df.columns]))


def fill_missing(df: DataFrame, c: str, strategy: str, value=None,
                 order_by: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Fill the missing cells of ``c``.

    mean / median: numeric columns only, result is double (as pandas turns ints into floats);
    mode: most frequent value, smallest on ties, column unchanged if it has no value at all;
    ffill: forward fill along ``order_by`` within ``partition_by``; drop: drop those rows; constant: ``value``.
    """
    check_columns(df, [c])
    if strategy not in FILL_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {FILL_STRATEGIES}")
    dt = df.schema[c].dataType
    if strategy in ("mean", "median") and not isinstance(dt, NUMERIC_TYPES):
        raise ValueError(f"{strategy} fill needs a numeric column, {c} is {dt.simpleString()}")
    x = nan_to_null(col(c)) if isinstance(dt, FRACTIONAL_TYPES) else col(c)
    if strategy == "mean":
        return _with_fill(df, c, df.agg(F.avg(x).alias("s")), T.DoubleType())
    if strategy == "median":
        med = quantiles_long(df.select(x.alias("_v")), [], "_v", [0.5]).select(F.col("q").alias("s"))
        # an all-missing column has no median row: keep one NULL row so the fill is a no-op
        med = df.sparkSession.range(1).join(med, F.lit(True), "left").select("s")
        return _with_fill(df, c, med, T.DoubleType())
    if strategy == "mode":
        m = mode_value(df.select(x.alias("_v")), "_v")
        m = df.sparkSession.range(1).join(m, F.lit(True), "left").select("_v")
        return _with_fill(df, c, m, dt)
    if strategy == "ffill":
        from quarry.operators.windows import forward_fill
        return forward_fill(df, c, order_by or [], partition_by)
    if strategy == "drop":
        return drop_missing(df, c)
    return fill_constant(df, c, value)


def fill_constant(df: DataFrame, c: str, value) -> DataFrame:
    """Fill with a constant cast to the column's type; an empty value or one that does not
    fit the type is an error (pandas would silently change the column's type instead)."""
    check_columns(df, [c])
    if value is None or (isinstance(value, str) and value == ""):
        raise ValueError("a constant fill needs a value")
    dt = df.schema[c].dataType
    if isinstance(dt, NUMERIC_TYPES):
        try:
            num = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"{value!r} is not a number; column {c} is {dt.simpleString()}")
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) \
                and num != int(num):
            raise ValueError(f"{value!r} does not fit integer column {c}")
        lit = F.lit(int(num) if num == int(num) and not isinstance(dt, FRACTIONAL_TYPES) else num)
    else:
        lit = F.lit(value)
    x = nan_to_null(col(c)) if isinstance(dt, FRACTIONAL_TYPES) else col(c)
    return df.select(*[F.coalesce(x, lit.cast(dt)).alias(y) if y == c else col(y)
                       for y in df.columns])


@nan_as_missing
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Remove whole-row duplicates (equal rows are identical, so which one stays is moot).
    The number removed is ``profile.duplicate_count`` of the input."""
    return df.dropDuplicates()


def iqr_fences(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Per numeric column: ``column, n, q1, q3, iqr, lower, upper`` (exact quartiles)."""
    cols = list(cols or numeric_columns(df))
    check_columns(df, cols)
    long_df = stack_columns(df, cols).withColumn("value", nan_to_null(F.col("value")))
    q = quantiles_long(long_df, ["column"], "value", [0.25, 0.75])
    n = long_df.groupBy("column").agg(F.count("value").alias("n"))
    qw = q.groupBy("column").agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                 F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return (n.join(qw, "column", "left")
            .select("column", "n", "q1", "q3", iqr.alias("iqr"),
                    (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper")))


def outliers(df: DataFrame, c: str, k: float = 1.5, flag: str | None = None) -> DataFrame:
    """Rows of ``c`` outside the IQR fence ``[Q1 - k IQR, Q3 + k IQR]``.

    With ``flag`` set, every row is kept and a boolean column of that name marks the
    outliers instead. The fence is one row, broadcast to the scan."""
    check_columns(df, [c])
    lower, upper = free_names(df, "lower", "upper")
    f = F.broadcast(iqr_fences(df, [c], k).select(F.col("lower").alias(lower), F.col("upper").alias(upper)))
    x = nan_to_null(col(c).cast("double"))
    out = (x < F.col(lower)) | (x > F.col(upper))
    j = df.crossJoin(f)
    if flag:
        return j.select(*[col(y) for y in df.columns], F.coalesce(out, F.lit(False)).alias(flag))
    return j.where(out).select(*[col(y) for y in df.columns])
