"""Profiling: describe, column profile, missing cells, duplicates, quality score, moments.

All scalar statistics of a table are computed in as few aggregate passes as possible (one
fused ``agg`` for counts, one for distinct counts, the distributed quantile for quartiles);
results are small DataFrames, one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import (FRACTIONAL_TYPES, NUMERIC_TYPES, adjusted_kurtosis, adjusted_skew, nan_as_missing,
                                    cell_text, check_columns, col, missing, nan_to_null,
                                    numeric_columns, row_hash, row_key, word_count)
from quarry.functions.kinds import TEXT_WORDS, _static_kind
from quarry.functions.quantiles import quantiles_long, stack_columns


def _clean_value(df: DataFrame, c: str):
    """Column with NaN read as missing."""
    x = col(c)
    return nan_to_null(x) if isinstance(df.schema[c].dataType, FRACTIONAL_TYPES) else x


def _numeric_long(df: DataFrame, cols: Sequence[str] | None) -> tuple[list[str], DataFrame]:
    cols = list(cols or numeric_columns(df))
    check_columns(df, cols)
    long_df = stack_columns(df, cols).withColumn("value", nan_to_null(F.col("value")))
    return cols, long_df


def describe(df: DataFrame, cols: Sequence[str] | None = None,
             round_to: int | None = 2) -> DataFrame:
    """count, mean, std (n-1), min, 25 %, 50 %, 75 %, max of each numeric column.

    Rows ``column, count, mean, std, min, p25, p50, p75, max``. The moments come from one
    aggregate over the long form; quartiles are exact (``quantiles_long``).
    """
    cols, long_df = _numeric_long(df, cols)
    v = F.col("value")
    moments = long_df.groupBy("column").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles_long(long_df, ["column"], "value", [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                   for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    out = moments.join(qw, "column", "left")
    r = (lambda c: F.round(c, round_to)) if round_to is not None else (lambda c: c)
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column"))
    return out.select("column", "count", r(F.col("mean")).alias("mean"),
                      r(F.col("std")).alias("std"), r(F.col("min")).alias("min"),
                      r(F.col("p25")).alias("p25"), r(F.col("p50")).alias("p50"),
                      r(F.col("p75")).alias("p75"), r(F.col("max")).alias("max")).orderBy(order)


def distribution(df: DataFrame, cols: Sequence[str] | None = None,
                 round_to: int | None = 6) -> DataFrame:
    """describe + sample-adjusted skewness and excess kurtosis per numeric column."""
    cols, long_df = _numeric_long(df, cols)
    v = F.col("value")
    shape = long_df.groupBy("column").agg(adjusted_skew(v).alias("skew"),
                                          adjusted_kurtosis(v).alias("kurtosis"))
    r = (lambda c: F.round(c, round_to)) if round_to is not None else (lambda c: c)
    base = describe(df, cols, round_to)
    return base.join(shape.select("column", r(F.col("skew")).alias("skew"),
                                  r(F.col("kurtosis")).alias("kurtosis")), "column", "left")


def moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """n, adjusted skewness and kurtosis per numeric column (rows ``column, n, skew, kurtosis``)."""
    cols, long_df = _numeric_long(df, cols)
    v = F.col("value")
    return long_df.groupBy("column").agg(F.count(v).alias("n"), adjusted_skew(v).alias("skew"),
                                         adjusted_kurtosis(v).alias("kurtosis"))


_UNORDERED = tuple(t for t in (T.MapType, getattr(T, "VariantType", None)) if t is not None)


def _orderable(dt: T.DataType) -> bool:
    """Types that min/max/distinct accept (maps and variants do not)."""
    return not isinstance(dt, _UNORDERED)


def _value_key(x, dt: T.DataType):
    """Text that differs for different values: short texts themselves, else a hash."""
    if isinstance(dt, T.StringType):
        return F.when(F.length(x) <= 16, F.concat(F.lit("="), x)).otherwise(F.md5(x.cast("binary")))
    if isinstance(dt, T.BinaryType):
        return F.md5(x)
    if isinstance(dt, FRACTIONAL_TYPES):
        return (x + F.lit(0).cast(dt)).cast("string")      # -0.0 equals 0.0
    if isinstance(dt, (T.ArrayType, T.StructType)):
        return F.when(x.isNotNull(), F.md5(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
                                           .cast("binary")))
    return x.cast("string")


def profile(df: DataFrame, approx: bool = False, text_words: float = TEXT_WORDS) -> DataFrame:
    """One row per column: ``column, dtype, kind, non_null, missing_pct, unique``.

    One aggregate pass computes non-missing counts and mean word counts of string columns (and
    HyperLogLog++ distinct counts with ``approx=True``). Exact distinct counts come from narrow
    (column, value key) entries that are combined map-side; the key of a text longer than 16
    characters or of a nested value is its MD5, so that no long value is shuffled. Rows are
    produced by ``inline``, so nothing is collected. Maps have no distinct count.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    entries = []
    for i, f in enumerate(fields):
        x = _clean_value(df, f.name)
        aggs.append(F.count(x).alias(f"n{i}"))
        if _orderable(f.dataType):
            if approx:
                aggs.append(F.approx_count_distinct(x).alias(f"d{i}"))
            else:
                entries.append(F.struct(F.lit(i).alias("i"), _value_key(x, f.dataType).alias("v")))
        if _static_kind(f.dataType) is None:
            aggs.append(F.avg(word_count(col(f.name))).alias(f"w{i}"))
    one = df.agg(*aggs)
    if entries:
        distinct = (df.select(F.inline(F.array(*entries))).where(F.col("v").isNotNull())
                    .groupBy("i", "v").agg(F.lit(1).alias("one"))
                    .groupBy("i").agg(F.count(F.lit(1)).alias("n"))
                    .agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("_distinct")))
        one = one.crossJoin(F.broadcast(distinct))     # one row, an entry per column
    unique = [(F.col(f"d{i}") if approx else F.coalesce(F.try_element_at("_distinct", F.lit(i)), F.lit(0)))
              if _orderable(f.dataType) else F.lit(None).cast("long") for i, f in enumerate(fields)]
    rows = []
    for i, f in enumerate(fields):
        k = _static_kind(f.dataType)
        kind = (F.when(F.col(f"w{i}") > F.lit(text_words), "text").otherwise("categorical")
                if k is None else F.lit(k))
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            kind.alias("kind"), F.col(f"n{i}").alias("non_null"),
            F.coalesce(F.round(F.try_divide((F.col("_rows") - F.col(f"n{i}")) * 100.0,
                                            F.col("_rows")), 1), F.lit(0.0))
            .alias("missing_pct"),
            unique[i].alias("unique")))
    return one.select(F.inline(F.array(*rows)))


def grouping_columns(df: DataFrame, low_cardinality: int = 20) -> DataFrame:
    """Columns to group by: text, and any column of fewer than ``low_cardinality`` distinct
    values, numbers too. Rows ``column, unique``."""
    return profile(df).where((F.col("dtype") == "string") | (F.col("unique") < low_cardinality)) \
        .select("column", "unique")


def quality_table(df: DataFrame) -> DataFrame:
    """Quality sheet of the report: ``column, missing_pct, unique``."""
    return profile(df).select("column", "missing_pct", "unique")


def missing_counts(df: DataFrame) -> DataFrame:
    """``column, missing, rows`` for every column, from one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"),
                     F.col("_rows").alias("rows")) for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*rows)))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most missing first: ``column, missing, missing_pct``."""
    m = missing_counts(df)
    return (m.where(F.col("missing") > 0)
            .select("column", "missing",
                    F.round(F.col("missing") * 100.0 / F.col("rows"), 1).alias("missing_pct"))
            .orderBy(F.desc("missing"), "column"))


def missing_total(df: DataFrame) -> DataFrame:
    """Total missing cells (one row)."""
    return missing_counts(df).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_total"))


@nan_as_missing
def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (all but the first of each group of equal rows).

    A hash aggregate over row digests (``row_key``) with a map-side combine, so a row repeated a
    billion times shrinks to one entry per task before the shuffle, and what is shuffled does not
    grow with the length of texts. One row ``duplicates``; a table without columns has 0."""
    key = row_key(df)
    if not key:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicates"))
    named = [k.alias(f"k{i}") for i, k in enumerate(key)]
    groups = df.select(*named).groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def quality_score(df: DataFrame) -> DataFrame:
    """``rows, columns, missing_cells, duplicates, quality`` (one row).

    quality = 100 - 50 * (missing cells / all cells) - 30 * (duplicates / rows), clipped to
    [0, 100] and rounded to 1 decimal; an empty table scores 0.0.
    """
    ncols = len(df.columns)
    # rows and missing cells in one pass, duplicates in a second (both one-row results)
    m = df.agg(F.count(F.lit(1)).alias("rows"),
               (sum((F.count_if(missing(df, c)) for c in df.columns), F.lit(0)))
               .alias("missing_total"))
    d = duplicate_count(df)
    one = m.crossJoin(d)
    n = F.col("rows").cast("double")
    score = (F.lit(100.0) - F.col("missing_total") / (n * ncols) * 50
             - F.col("duplicates") / n * 30)
    score = F.when((F.col("rows") == 0) | (F.lit(ncols) == 0), F.lit(0.0)).otherwise(
        F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1))
    return one.select("rows", F.lit(ncols).alias("columns"),
                      F.col("missing_total").alias("missing_cells"), "duplicates",
                      score.alias("quality"))


def meta(df: DataFrame) -> DataFrame:
    """Dataset meta: ``rows, columns, quality, column_names``."""
    names = F.array(*[F.lit(c) for c in df.columns]) if df.columns else F.array()
    return quality_score(df).select("rows", "columns", "quality",
                                    names.cast("array<string>").alias("column_names"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct non-missing value: ``column, constant``.

    min == max (or all missing) decides it in one aggregate, no distinct needed."""
    fields = [f for f in df.schema.fields if _orderable(f.dataType)]
    aggs = []
    for i, f in enumerate(fields):
        x = _clean_value(df, f.name)
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column"),
                     (F.col(f"a{i}").isNull() | (F.col(f"a{i}") == F.col(f"b{i}")))
                     .alias("constant")) for i, f in enumerate(fields)]
    return one.select(F.inline(F.array(*rows)))


def central(df: DataFrame, c: str) -> DataFrame:
    """Mean, median and mode of one column (one row); mode ties go to the smallest value."""
    check_columns(df, [c])
    x = _clean_value(df, c)
    vals = df.select(x.alias("v")).where(F.col("v").isNotNull())
    if isinstance(df.schema[c].dataType, NUMERIC_TYPES):
        mean = vals.agg(F.avg(F.col("v").cast("double")).alias("mean"))
        med = quantiles_long(vals, [], "v", [0.5]).agg(F.max("q").alias("median"))
    else:           # text, times and flags have only a mode
        mean = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("mean"))
        med = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("median"))
    mode = mode_value(vals, "v").agg(F.max("v").alias("mode"))
    # three one-row frames
    return mean.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(mode))


def mode_value(df: DataFrame, c: str) -> DataFrame:
    """Most frequent non-missing value (smallest on ties) as a 0- or 1-row frame.

    Counts per value are combined map-side and shuffled by value; the top-1 is a
    TakeOrderedAndProject, so no single buffer holds all distinct values."""
    return (df.where(col(c).isNotNull()).groupBy(col(c)).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.desc("_n"), col(c)).limit(1).select(col(c)))


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None,
            mode: str = "head", seed: int = 42) -> DataFrame:
    """First / last / random n rows with every cell as text (missing -> "").

    ``head`` and ``tail`` follow ``order_by`` (Spark rows have no order of their own);
    ``random`` orders by a seeded hash of the whole row, so it repeats exactly."""
    if not 1 <= n <= 500:
        raise ValueError("n must be within 1..500")
    order_by = list(order_by or [])
    check_columns(df, order_by)
    if mode == "head":
        s = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    elif mode == "tail":
        if not order_by:
            raise ValueError("tail needs order_by")
        s = df.orderBy(*[col(c).desc() for c in order_by])
    elif mode == "random":
        s = df.orderBy(row_hash(seed, [col(c) for c in df.columns]))
    else:
        raise ValueError(f"unknown preview mode {mode!r}")
    return s.limit(n).select(*[cell_text(col(c)).alias(c) for c in df.columns])
