"""Grouped aggregates, value counts, top-N, shares, cross-tabs, periods, words, correlation.

Group rules (as in the pandas calls being re-expressed): rows whose group key is missing are
dropped; missing values are skipped; the sum of a group with only missing values is 0 while
mean/min/max stay NULL; ``count`` counts non-missing values.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import check_columns, col, nan_as_missing, numeric_columns, safe_div
from quarry.functions.quantiles import quantiles_long

# Aggregation names accepted by the chart and pivot requests.
AGGREGATIONS = ("sum", "mean", "count", "min", "max", "median")


def agg_expr(c: str | Column, how: str) -> Column:
    """Aggregate expression for one of AGGREGATIONS except median (see ``group_agg``)."""
    x = col(c)
    if how == "sum":
        return F.coalesce(F.sum(x), F.lit(0))
    if how == "mean":
        return F.avg(x)
    if how == "count":
        return F.count(x)
    if how == "min":
        return F.min(x)
    if how == "max":
        return F.max(x)
    raise ValueError(f"unknown aggregation {how!r}; expected one of {AGGREGATIONS}")


def keys_present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows whose group key is missing (pandas groups drop them; Spark keeps a NULL group)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & col(k).isNotNull()
    return df.where(cond)


@nan_as_missing
def group_agg(df: DataFrame, x: str | Sequence[str], y: str, agg: str = "sum",
              color: str | None = None, alias: str | None = None) -> DataFrame:
    """Aggregate ``y`` per ``x`` (and ``color``): rows ``keys + [alias or y]``.

    One hash aggregate with a map-side partial step, so a hot key is combined before the
    shuffle. ``median`` uses the exact distributed quantile.
    """
    xs = [x] if isinstance(x, str) else list(x)
    keys = xs + ([color] if color else [])
    check_columns(df, keys + [y])
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}; expected one of {AGGREGATIONS}")
    out = alias or y
    base = keys_present(df, keys)
    if agg == "median":
        q = quantiles_long(base.select(*[col(k) for k in keys], col(y)), keys, y, [0.5])
        groups = base.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_rows"))
        # groups with only missing values still appear, with a NULL median
        return (groups.join(q, keys, "left")
                .select(*[col(k) for k in keys], F.col("q").alias(out)))
    return base.groupBy(*[col(k) for k in keys]).agg(agg_expr(y, agg).alias(out))


@nan_as_missing
def value_counts(df: DataFrame, x: str, top_n: int | None = None,
                 name: str = "count") -> DataFrame:
    """Counts of each non-missing value, descending; ties ordered by value. ``top_n`` keeps
    the first n (planned as TakeOrderedAndProject, no full sort)."""
    check_columns(df, [x])
    vc = (df.where(col(x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias(name))
          .orderBy(F.desc(name), col(x)))
    return vc.limit(top_n) if top_n else vc


@nan_as_missing
def shares(df: DataFrame, x: str, top_n: int | None = None) -> DataFrame:
    """Value counts with each slice's share of the slices shown (pie / treemap data)."""
    vc = value_counts(df, x, top_n)
    # the total is a one-row aggregate: broadcasting it is bounded by construction
    total = vc.agg(F.sum("count").alias("_total"))
    return (vc.crossJoin(F.broadcast(total))
            .select(col(x), "count", (F.col("count") / F.col("_total")).alias("share"))
            .orderBy(F.desc("count"), col(x)))


@nan_as_missing
def top_n(df: DataFrame, x: str, y: str, agg: str = "sum", n: int = 10,
          alias: str | None = None) -> DataFrame:
    """Aggregate per x, keep the n largest (ties by x)."""
    out = alias or y
    return group_agg(df, x, y, agg, alias=out).orderBy(F.desc(out), col(x)).limit(n)


@nan_as_missing
def line(df: DataFrame, x: str, y: str, color: str | None = None,
         agg: str | None = None) -> DataFrame:
    """Line / area data: rows ordered by x (aggregated per x and colour when ``agg`` is given)."""
    check_columns(df, [x, y, color])
    keys = [x] + ([color] if color else [])
    if agg:
        return group_agg(df, x, y, agg, color).orderBy(*[col(k) for k in keys])
    return df.select(*[col(k) for k in keys], col(y)).orderBy(*[col(k) for k in keys])


def pivot_keys(df: DataFrame, columns: Sequence[str], code: Column) -> list[tuple[str, tuple]]:
    """Distinct column keys in order, as (code, labels): those of a wide table, at most
    ``spark.sql.pivotMaxValues`` (Spark's own bound for pivots; more raise)."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    times = ("timestamp", "timestamp_ntz", "date")
    label = [(col(c).cast("string") if df.schema[c].dataType.typeName() in times else col(c)).alias(f"l{i}")
             for i, c in enumerate(columns)]
    found = (df.select(F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(columns)]).alias("k"),
                       F.struct(*label).alias("label"), code.alias("code"))
             .distinct().limit(most + 1).orderBy("k").select("code", "label").collect())
    if len(found) > most:
        raise ValueError(f"more than {most} column keys: use the long form")
    return [(r["code"], tuple(r["label"])) for r in found]


@nan_as_missing
def crosstab(df: DataFrame, x: str, y: str, y_values: Sequence | None = None) -> DataFrame:
    """Counts of x by y with absent combinations as 0; missing keys dropped.

    Counts are aggregated on (x, y) first and then pivoted, so the pivot works on the small
    counts table. ``y_values`` (the output columns) are read from the data when not given, up to
    Spark's bound for pivots; ``group_agg(df, x, y, "count", color=y)`` is the long form.
    """
    from quarry.operators.pivot import given_keys, key_code
    check_columns(df, [x, y])
    t = df.schema[y].dataType
    pairs = (keys_present(df, [x, y]).groupBy(col(x).alias("_x"), col(y).alias("_y"))
             .agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_code", key_code([F.col("_y")], [t])))
    keys = pivot_keys(pairs, ["_y"], F.col("_code")) if y_values is None \
        else given_keys(df.sparkSession, y_values, [t])
    out = pairs.groupBy("_x").pivot("_code", [c for c, _ in keys]).agg(F.first("_n"))
    cells, taken = [], {x.lower()}
    for code, (v,) in keys:
        name, n = str(v), 1
        while name.lower() in taken:
            n += 1
            name = f"{v} ({n})"
        taken.add(name.lower())
        cells.append(F.coalesce(F.col(f"`{code}`"), F.lit(0)).alias(name))
    return out.select(F.col("_x").alias(x), *cells).orderBy(col(x))


# Period units understood by ``by_period`` (Spark date_trunc names).
PERIODS = ("year", "quarter", "month", "week", "day", "hour", "minute")


@nan_as_missing
def by_period(df: DataFrame, ts: str, unit: str = "day", y: str | None = None,
              agg: str = "count", alias: str | None = None) -> DataFrame:
    """Counts (or agg of y) per calendar period of a timestamp column."""
    if unit not in PERIODS:
        raise ValueError(f"unknown period {unit!r}; expected one of {PERIODS}")
    check_columns(df, [ts, y])
    p = F.date_trunc(unit, col(ts)).alias("period")
    base = df.where(col(ts).isNotNull())
    if y is None:
        return base.groupBy(p).agg(F.count(F.lit(1)).alias(alias or "count")).orderBy("period")
    return base.groupBy(p).agg(agg_expr(y, agg).alias(alias or y)).orderBy("period")


def word_counts(df: DataFrame, text: str, top_n: int | None = None) -> DataFrame:
    """Word frequencies of a text column (word-cloud data): lower case, split on anything that
    is not a letter or digit, empty tokens dropped. Each task counts its own words first."""
    check_columns(df, [text])
    words = (df.select(F.explode(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+")).alias("word"))
             .where(F.col("word") != ""))
    return value_counts(words, "word", top_n)


@nan_as_missing
def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation in long form ``a, b, r`` (both orders and the
    diagonal); NULL when a side is constant (pandas gives NaN).

    Each row is expanded to one (pair, x, y) entry per column pair present in it and
    aggregated by pair: three aggregate functions (covariance and two deviations) keep the
    stage inside whole-stage codegen whatever the number of columns, and the partial
    aggregate leaves one row per pair and task before the shuffle."""
    cols = list(cols or numeric_columns(df))
    check_columns(df, cols)
    pairs = [(i, i) for i in range(len(cols))] + list(combinations(range(len(cols)), 2))
    entries = F.array(*[F.struct(F.lit(k).alias("_k"), col(cols[i]).cast("double").alias("_x"),
                                 col(cols[j]).cast("double").alias("_y"))
                        for k, (i, j) in enumerate(pairs)])
    x, y = F.col("_x"), F.col("_y")
    r = (df.select(F.inline(entries)).where(x.isNotNull() & y.isNotNull())
         .groupBy("_k").agg(safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
                            .alias("r")))
    names = F.array(*[F.lit(c) for c in cols])
    ia = F.array(*[F.lit(i) for i, _ in pairs])[F.col("_k")]
    ib = F.array(*[F.lit(j) for _, j in pairs])[F.col("_k")]
    # every pair appears even when it has no complete row
    keys = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("_k"))
    full = keys.join(r, "_k", "left")
    fwd = full.select(names[ia].alias("a"), names[ib].alias("b"), "r")
    back = full.where(ia != ib).select(names[ib].alias("a"), names[ia].alias("b"), "r")
    return fwd.unionByName(back)


@nan_as_missing
def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Square matrix: one row per column, one column per column (heat-map data)."""
    cols = list(cols or numeric_columns(df))
    long_r = correlation(df, cols)
    return (long_r.groupBy(F.col("a").alias("column")).pivot("b", cols).agg(F.first("r"))
            .orderBy(F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column"))))


@nan_as_missing
def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct pairs (a before b in column order) ranked by |r|, strongest first."""
    cols = list(cols or numeric_columns(df))
    long_r = correlation(df, cols)
    pos = F.array(*[F.lit(c) for c in cols])
    return (long_r.where(F.array_position(pos, F.col("a")) < F.array_position(pos, F.col("b")))
            .orderBy(F.desc_nulls_last(F.abs("r")), "a", "b"))
