"""Chart data from binning: histograms, densities, 2-D bins, box and violin summaries, points.

The range of a column is one aggregate (one row, cross-joined as a broadcast: bounded by
construction); bin numbers are plain arithmetic inside the scan's codegen span; counts are
a hash aggregate with a map-side combine. Equal-width bins, the last one closed:
``bin = least(floor((x - lo) / w), bins - 1)`` with ``w = (hi - lo) / bins``; a constant
column has one bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import NUMERIC_TYPES, check_columns, col, free_names, nan_to_null, row_hash
from quarry.functions.quantiles import join_facts, quantiles_long

POINT_PARTS = 64        # parts of a colour that are ranked on their own first


def _bin(x: Column, lo: Column, w: Column, bins: int) -> Column:
    return F.when(w > 0, F.least(F.floor((x - lo) / w), F.lit(bins - 1))).otherwise(0) \
        .cast("int")


def _range(df: DataFrame, x: str, bins: int, prefix: str) -> DataFrame:
    v = nan_to_null(col(x).cast("double"))
    return df.agg(F.min(v).alias(f"{prefix}lo"), F.max(v).alias(f"{prefix}hi")) \
        .withColumn(f"{prefix}w", (F.col(f"{prefix}hi") - F.col(f"{prefix}lo")) / bins)


def histogram(df: DataFrame, x: str, bins: int = 30, color: str | None = None) -> DataFrame:
    """Rows ``[color,] bin, lower, upper, count`` for the bins that hold data."""
    check_columns(df, [x, color])
    if bins < 1:
        raise ValueError("bins must be positive")
    if not isinstance(df.schema[x].dataType, NUMERIC_TYPES):
        # text has no bins: the counts of its values
        return df.where(col(x).isNotNull()).groupBy(*([col(color)] if color else []), col(x)) \
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col(x))
    rng = _range(df, x, bins, "_")
    v = nan_to_null(col(x).cast("double"))
    keys = [col(color)] if color else []
    j = df.select(*keys, v.alias("_x")).where(F.col("_x").isNotNull()) \
          .crossJoin(F.broadcast(rng))
    b = _bin(F.col("_x"), F.col("_lo"), F.col("_w"), bins).alias("bin")
    g = j.groupBy(*keys, b, "_lo", "_w").agg(F.count(F.lit(1)).alias("count"))
    return g.select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"), "count")


def density(df: DataFrame, x: str, bins: int = 40, color: str | None = None) -> DataFrame:
    """Histogram with ``density = count / bin width`` (a constant column: width 1)."""
    h = histogram(df, x, bins, color)
    w = F.col("upper") - F.col("lower")
    return h.withColumn("density", F.col("count") / F.when(w > 0, w).otherwise(F.lit(1.0)))


def rug(df: DataFrame, x: str, color: str | None = None) -> DataFrame:
    """Marks of a density chart: ``[color,] x, count`` for each distinct value."""
    check_columns(df, [x, color])
    v = nan_to_null(col(x).cast("double"))
    keys = [col(color)] if color else []
    return df.where(v.isNotNull()).groupBy(*keys, v.alias(x)).agg(F.count(F.lit(1)).alias("count"))


def hist2d(df: DataFrame, x: str, y: str, nx: int = 20, ny: int = 20,
           color: str | None = None) -> DataFrame:
    """Two-dimensional bin counts ``[color,] bx, by, count`` (heat-map / contour grid)."""
    check_columns(df, [x, y, color])
    rx, ry = _range(df, x, nx, "_x"), _range(df, y, ny, "_y")
    keys = [col(color)] if color else []
    vx, vy = nan_to_null(col(x).cast("double")), nan_to_null(col(y).cast("double"))
    j = (df.select(*keys, vx.alias("_vx"), vy.alias("_vy"))
         .where(F.col("_vx").isNotNull() & F.col("_vy").isNotNull())
         .crossJoin(F.broadcast(rx.crossJoin(ry))))
    bx = _bin(F.col("_vx"), F.col("_xlo"), F.col("_xw"), nx).alias("bx")
    by = _bin(F.col("_vy"), F.col("_ylo"), F.col("_yw"), ny).alias("by")
    return j.groupBy(*keys, bx, by).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, y: str, by: str | None = None, k: float = 1.5) -> DataFrame:
    """Per group: ``n, min, q1, median, q3, max, lower_whisker, upper_whisker, outliers``.

    Whisker ends are the most extreme values inside the fences ``[q1 - k IQR, q3 + k IQR]``.
    Quartiles come from the distributed exact quantile; the fences (one row per group) go back
    to the rows for one more aggregate pass."""
    check_columns(df, [y, by])
    keys = [by] if by else []
    data = df.select(*[col(c) for c in keys], nan_to_null(col(y).cast("double")).alias("_y")) \
             .where(F.col("_y").isNotNull())
    if by:
        data = data.where(col(by).isNotNull())
        data = data.withColumnRenamed(by, "_g")
    gk = ["_g"] if by else []
    q = quantiles_long(data, gk, "_y", [0.25, 0.5, 0.75])
    qw = q.groupBy(*gk).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                              for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    iqr = F.col("q3") - F.col("q1")
    fences = qw.select(*gk, "q1", "median", "q3", (F.col("q1") - k * iqr).alias("_lo"),
                       (F.col("q3") + k * iqr).alias("_hi"))
    j = join_facts(data, fences, gk)
    inside = (F.col("_y") >= F.col("_lo")) & (F.col("_y") <= F.col("_hi"))
    out = j.groupBy(*gk, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min("_y").alias("min"), F.max("_y").alias("max"),
        F.min(F.when(inside, F.col("_y"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_y"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"))
    cols = ["n", "min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker", "outliers"]
    return out.select(*([F.col("_g").alias(by)] if by else []), *cols)


VIOLIN_STEPS = 4      # density points per bandwidth
VIOLIN_REACH = 4      # bandwidths after which the kernel counts as 0


def violin(df: DataFrame, y: str, by: str | None = None, box: bool = False) -> DataFrame:
    """Gaussian kernel density of y per group: rows ``[by,] y, density``.

    Bandwidth: Silverman's rule, ``0.9 * min(sd, IQR / 1.34) * n^(-1/5)`` (sd when the IQR is 0;
    1 for equal values). Rows are counted in bins a quarter of the bandwidth wide, whatever the
    range, and each bin that holds rows adds its kernel to the points within four bandwidths;
    points farther from all rows, where the density is 0, have no row. So the work follows the
    bins that hold rows, and a distant outlier changes nothing elsewhere.

    With ``box`` every row also carries ``q1, median, q3, lower_whisker, upper_whisker``.
    """
    check_columns(df, [y, by])
    keys = [by] if by else []
    data = df.select(*[col(c).alias("_g") for c in keys], nan_to_null(col(y).cast("double")).alias("_y")) \
             .where(F.col("_y").isNotNull())
    if by:
        data = data.where(F.col("_g").isNotNull())
    gk = ["_g"] if by else []
    stats = data.groupBy(*gk).agg(F.count(F.lit(1)).alias("_n"), F.min("_y").alias("_lo"),
                                  F.stddev_samp("_y").alias("_sd"))
    q = quantiles_long(data, gk, "_y", [0.25, 0.75])
    qi = q.groupBy(*gk).agg((F.max(F.when(F.col("p") == 0.75, F.col("q")))
                             - F.max(F.when(F.col("p") == 0.25, F.col("q")))).alias("_iqr"))
    sd = F.coalesce(F.col("_sd"), F.lit(0.0))
    spread = F.when((F.col("_iqr") > 0) & (F.col("_iqr") / 1.34 < sd), F.col("_iqr") / 1.34) \
        .otherwise(sd)
    h = 0.9 * spread * F.pow(F.col("_n"), F.lit(-0.2))
    st = (stats.join(qi, gk) if gk else stats.crossJoin(qi)) \
        .select(*gk, "_n", "_lo", F.when(h > 0, h).otherwise(F.lit(1.0)).alias("_h"))
    j = join_facts(data, st, gk)
    b = F.floor((F.col("_y") - F.col("_lo")) / (F.col("_h") / VIOLIN_STEPS))
    reach = VIOLIN_STEPS * VIOLIN_REACH
    d = F.col("_d") / VIOLIN_STEPS
    out = (j.groupBy(*gk, "_lo", "_h", "_n", b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
           .select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_d"))
           .groupBy(*gk, "_lo", "_h", "_n", (F.col("_b") + F.col("_d")).alias("_i"))
           .agg(F.sum(F.col("_c") * F.exp(-0.5 * d * d)).alias("_k"))
           .select(*[F.col(g).alias(by) for g in gk],
                   (F.col("_lo") + (F.col("_i") + 0.5) * F.col("_h") / VIOLIN_STEPS).alias("y"),
                   (F.col("_k") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density")))
    if box:
        out = join_facts(out, box_stats(df, y, by).select(
            *[col(c) for c in keys], "q1", "median", "q3", "lower_whisker", "upper_whisker"), keys)
    return out.orderBy(*[col(c) for c in keys], "y")


def points(df: DataFrame, cols: Sequence[str], color: str | None = None,
           max_points: int | None = None, key: Sequence[str] | None = None,
           seed: int = 42) -> DataFrame:
    """Raw points for scatter / strip / pair / 3-D / parallel / rug charts: all rows.

    With ``max_points`` a sample: each colour group keeps at most that many rows, the first by a
    seeded hash of ``key`` (all columns by default), so the sample repeats exactly. The rows of a
    colour are first ranked in ``POINT_PARTS`` parts, whatever ``max_points`` is, and the firsts of
    the parts then together, so no task gets a whole colour.
    """
    cols = list(cols)
    check_columns(df, cols + [color])
    out_cols = [col(c) for c in cols + ([color] if color and color not in cols else [])]
    if not max_points:
        return df.select(*out_cols)
    keycols = [col(c) for c in (key or df.columns)]
    u = row_hash(seed, keycols)
    if not color:
        return df.orderBy(u, *keycols).limit(max_points).select(*out_cols)
    place, part = free_names(df, "place", "part")
    out = df.withColumn(part, F.monotonically_increasing_id() % POINT_PARTS)
    for by in ([col(color), part], [col(color)]):
        w = Window.partitionBy(*by).orderBy(u, *keycols)
        out = out.withColumn(place, F.row_number().over(w)).where(F.col(place) <= max_points)
    return out.select(*out_cols)
