"""Trend fits (linear, polynomial, exponential), fitted curves, standardising and k-means.

Fits are sums over the rows: one aggregate gives every sum a fit needs, and the few numbers
of the normal equations are solved where they are small. Linear and exponential fits stay
lazy DataFrames end to end; the polynomial fit reads its (d+1) x (d+1) system of power sums
to the driver, solves it with NumPy and computes R² in a second pass with the coefficients
as literals. R² = 1 - SSres / max(SStot, 1e-10), rounded to 4 places; fewer than 4 complete
rows give no fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import check_columns, col, nan_to_null

MIN_ROWS = 4
CURVE_POINTS = 300
# Fit kinds of the trend-line request.
TREND_KINDS = ("linear", "polynomial", "exponential", "all")


def _xy(df: DataFrame, x: str, y: str) -> DataFrame:
    check_columns(df, [x, y])
    return (df.select(nan_to_null(col(x).cast("double")).alias("x"),
                      nan_to_null(col(y).cast("double")).alias("y"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def _r2(ssres: Column, sstot: Column) -> Column:
    return F.round(1 - ssres / F.greatest(sstot, F.lit(1e-10)), 4)


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of a scatter: ``n, slope, intercept, r2`` (one row)."""
    d = _xy(df, x, y)
    return d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"),
                 F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """``kind, n, coefficients (highest power first), r2, x_min, x_max`` for y = a x + b.

    SSres = Syy - Sxy² / Sxx and SStot = Syy come from the same single aggregate."""
    d = _xy(df, x, y)
    a = d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("a"),
              F.regr_intercept("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"),
              F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
              F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    ok = F.col("n") >= MIN_ROWS
    ssres = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    return a.select(F.lit("linear").alias("kind"), "n",
                    F.when(ok, F.array(F.col("a"), F.col("b"))).alias("coefficients"),
                    F.when(ok, _r2(ssres, F.col("syy"))).alias("r2"), "x_min", "x_max")


def exponential_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = a e^{b x} from a line through ln y (only when every y > 0); R² on the original
    scale from a second pass with the one-row fit broadcast. ``coefficients = [a, b]``."""
    d = _xy(df, x, y)
    f = d.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("_ymin"),
              F.regr_slope(F.ln(F.when(F.col("y") > 0, F.col("y"))), "x").alias("_b"),
              F.regr_intercept(F.ln(F.when(F.col("y") > 0, F.col("y"))), "x").alias("_c"),
              F.avg("y").alias("_ybar"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    f = f.withColumn("_a", F.exp("_c"))
    yp = F.col("_a") * F.exp(F.col("_b") * F.col("x"))
    ss = d.crossJoin(F.broadcast(f)).agg(
        F.sum((F.col("y") - yp) * (F.col("y") - yp)).alias("_ssres"),
        F.sum((F.col("y") - F.col("_ybar")) * (F.col("y") - F.col("_ybar"))).alias("_sstot"))
    ok = (F.col("n") >= MIN_ROWS) & (F.col("_ymin") > 0) & F.col("_b").isNotNull()
    return f.crossJoin(ss).select(
        F.lit("exponential").alias("kind"), "n",
        F.when(ok, F.array(F.col("_a"), F.col("_b"))).alias("coefficients"),
        F.when(ok, _r2(F.col("_ssres"), F.col("_sstot"))).alias("r2"), "x_min", "x_max")


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int = 2) -> DataFrame:
    """Least-squares polynomial of ``degree`` (2..5) like ``numpy.polyfit``.

    x is standardised before the power sums (raw powers lose precision past degree 3); the
    coefficients are mapped back to powers of x."""
    if not 1 <= degree <= 5:
        raise ValueError("degree must be within 1..5")
    d = _xy(df, x, y)
    spark = df.sparkSession
    m = d.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"),
              F.stddev_pop("x").alias("sx"), F.min("x").alias("x_min"),
              F.max("x").alias("x_max")).first()
    n = m["n"]
    if n < MIN_ROWS or n <= degree:
        return spark.createDataFrame(
            [("polynomial", n, None, None, m["x_min"], m["x_max"])],
            "kind string, n long, coefficients array<double>, r2 double, "
            "x_min double, x_max double")
    mx, sx = float(m["mx"]), float(m["sx"]) or 1.0
    t = (F.col("x") - mx) / sx
    sums = d.agg(*[F.sum(F.pow(t, k)).alias(f"t{k}") for k in range(2 * degree + 1)],
                 *[F.sum(F.pow(t, k) * F.col("y")).alias(f"ty{k}") for k in range(degree + 1)]
                 ).first()
    M = np.array([[sums[f"t{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    v = np.array([sums[f"ty{i}"] for i in range(degree + 1)])
    c, *_ = np.linalg.lstsq(M, v, rcond=None)          # ascending powers of t
    # p(x) = sum c_k ((x - mx)/sx)^k  ->  ascending powers of x
    xc = np.zeros(degree + 1)
    for k, ck in enumerate(c):
        for j in range(k + 1):
            xc[j] += ck * comb(k, j) * (-mx) ** (k - j) / sx ** k
    coeffs = [float(v_) for v_ in xc[::-1]]            # highest power first, as polyfit
    yp = F.lit(0.0)
    for a in coeffs:                                   # Horner
        yp = yp * F.col("x") + F.lit(a)
    ss = d.crossJoin(F.broadcast(d.agg(F.avg("y").alias("_ybar")))).agg(
        F.sum((F.col("y") - yp) * (F.col("y") - yp)).alias("_ssres"),
        F.sum((F.col("y") - F.col("_ybar")) * (F.col("y") - F.col("_ybar"))).alias("_sstot"))
    return ss.select(F.lit("polynomial").alias("kind"), F.lit(n).cast("long").alias("n"),
                     F.array(*[F.lit(a) for a in coeffs]).alias("coefficients"),
                     _r2(F.col("_ssres"), F.col("_sstot")).alias("r2"),
                     F.lit(m["x_min"]).cast("double").alias("x_min"),
                     F.lit(m["x_max"]).cast("double").alias("x_max"))


def trendline(df: DataFrame, x: str, y: str, kind: str = "linear", degree: int = 3) -> DataFrame:
    """Fits of one kind, or all three (linear, polynomial of degree 3, exponential)."""
    if kind not in TREND_KINDS:
        raise ValueError(f"unknown trend {kind!r}; expected one of {TREND_KINDS}")
    if kind == "linear":
        return linear_fit(df, x, y)
    if kind == "polynomial":
        return polynomial_fit(df, x, y, degree)
    if kind == "exponential":
        return exponential_fit(df, x, y)
    return (linear_fit(df, x, y).unionByName(polynomial_fit(df, x, y, 3))
            .unionByName(exponential_fit(df, x, y)))


def trend_curve(fits: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """Fitted curves on ``points`` evenly spaced x from x_min to x_max: ``kind, x, y``."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")
    g = fits.where(F.col("coefficients").isNotNull()).select("*", i)
    xv = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("_i") / max(points - 1, 1)
    g = g.withColumn("x", xv)
    horner = F.aggregate("coefficients", F.lit(0.0), lambda acc, c: acc * F.col("x") + c)
    expo = F.col("coefficients")[0] * F.exp(F.col("coefficients")[1] * F.col("x"))
    return g.select("kind", "x", F.when(F.col("kind") == "exponential", expo)
                    .otherwise(horner).alias("y"))


def trend_over_time(df: DataFrame, ts: str, y: str) -> DataFrame:
    """Linear trend of y against time (x = epoch seconds, fractions kept).

    A zone-less timestamp is measured from the zone-less epoch, so the session time zone
    cannot shift x."""
    check_columns(df, [ts, y])
    dt = df.schema[ts].dataType.simpleString()
    if dt == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        secs = F.timestamp_diff("MICROSECOND", epoch, col(ts)) / 1e6
    elif dt == "date":
        secs = F.unix_date(col(ts)).cast("double") * 86400.0
    else:
        secs = F.unix_micros(col(ts).cast("timestamp")) / 1e6
    d = df.withColumn("_t", secs.cast("double"))
    return linear_fit(d, "_t", y)


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(c - mean) / population sd on rows complete in ``cols``; a constant column becomes 0.
    The means and sds are one aggregate row, broadcast to the scan."""
    cols = list(cols)
    check_columns(df, cols + list(keep))
    comp = df.dropna(subset=cols)
    st = comp.agg(*[F.avg(col(c)).alias(f"_m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(col(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = comp.crossJoin(F.broadcast(st))
    z = [F.coalesce(F.try_divide(col(c) - F.col(f"_m{i}"), F.when(F.col(f"_s{i}") > 0,
                                                                   F.col(f"_s{i}"))),
                    F.lit(0.0)).alias(c) for i, c in enumerate(cols)]
    return j.select(*[col(k) for k in keep], *z)


def _start_centres(rows: DataFrame, d: int, k: int, seed: int) -> list[tuple]:
    """k-means++ centres: each next row is drawn with a chance in proportion to its squared
    distance from the nearest centre so far, by the smallest ``-ln(u) / distance`` where u is a
    seeded hash of the row's own values (``_h``). One aggregate a centre; row order plays no part."""
    zs = [F.col(f"_z{i}") for i in range(d)]
    centres: list[tuple] = []
    for j in range(k):
        u = (F.xxhash64(F.lit(seed + j), F.col("_h")).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
        dist = _nearest(zs, centres)[1] if centres else F.lit(1.0)
        race = F.when(dist > 0, -F.log(u) / dist)
        best = rows.agg(F.min_by(F.struct(*zs), F.struct(race.isNull(), race, *zs)).alias("z")).first()["z"]
        if best is None:
            break
        centres.append(tuple(best))
    return centres


def _nearest(zs: list, centres: list[tuple]):
    """Number of the nearest centre (first on ties) and the squared distance to it."""
    ds = [sum((((z - F.lit(float(c))) * (z - F.lit(float(c)))) for z, c in zip(zs, centre)), F.lit(0.0))
          for centre in centres]
    least = F.least(*ds) if len(ds) > 1 else ds[0]
    which = F.lit(len(ds) - 1)
    for i in range(len(ds) - 2, -1, -1):
        which = F.when(ds[i] <= least, F.lit(i)).otherwise(which)
    return which, least


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, standardize_features: bool = True,
           seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """K-means on rows complete in ``features``; every column kept plus ``Cluster`` C1..Ck.

    Lloyd's rounds from k-means++ centres, one aggregate of k rows a round, until the centres
    move by no more than ``tol`` times the mean variance (squared, summed). Without that after
    ``max_iter`` rounds a ValueError says so. Neither the start nor the rounds depend on the
    layout of partitions, but for the last digits of sums. Clusters are numbered by their
    centres' coordinates (lexicographic). Fewer distinct rows than k give fewer clusters; an
    empty cluster keeps its centre."""
    features = list(features)
    if len(features) < 2:
        raise ValueError("k-means takes two features or more")
    if not 2 <= k <= 8:
        raise ValueError("k must be within 2..8")
    check_columns(df, features)
    comp = df.dropna(subset=features)
    x = [col(c).cast("double") for c in features]
    d = len(features)
    st = comp.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
                  *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x)]).first()
    if standardize_features:
        zs = [(v - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"]) if st[f"s{i}"] else F.lit(0.0)
              for i, v in enumerate(x)]
        variance = sum(1.0 for i in range(d) if st[f"s{i}"]) / d
    else:
        zs = x
        variance = sum((st[f"s{i}"] or 0.0) ** 2 for i in range(d)) / d
    # only the coordinates are read again each round, by all cores even of a file of one part
    rows = comp.select(F.xxhash64(*x).alias("_h"), *[z.alias(f"_z{i}") for i, z in enumerate(zs)])
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    rows = rows.persist()
    try:
        centres = sorted(set(_start_centres(rows, d, k, seed)))
        cz = [F.col(f"_z{i}") for i in range(d)]
        moved = 0.0
        for _ in range(max_iter if centres else 0):
            which, _dist = _nearest(cz, centres)
            means = {r["w"]: tuple(r[f"c{i}"] for i in range(d)) for r in rows.groupBy(which.alias("w")).agg(
                *[F.avg(z).alias(f"c{i}") for i, z in enumerate(cz)]).collect()}      # k rows
            new = [means.get(i, c) for i, c in enumerate(centres)]
            moved = sum((a - b) ** 2 for p, q in zip(centres, new) for a, b in zip(p, q))
            centres = new
            if moved <= tol * variance:
                break
        else:
            if centres:
                raise ValueError(f"k-means has not settled after {max_iter} rounds")
    finally:
        rows.unpersist()
    if not centres:
        return comp.withColumn("Cluster", F.lit(None).cast("string"))
    names = F.array(*[F.lit(f"C{i + 1}") for i in range(len(centres))])
    which, _dist = _nearest(zs, sorted(centres))
    return comp.select(*[col(c) for c in df.columns], names[which].alias("Cluster"))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """``Cluster, Count`` ordered by size (largest first)."""
    return (labelled.groupBy("Cluster").agg(F.count(F.lit(1)).alias("Count"))
            .orderBy(F.desc("Count"), "Cluster"))


def cluster_means(labelled: DataFrame, features: Sequence[str], round_to: int = 2) -> DataFrame:
    """Mean of each feature per cluster, in original units, rounded."""
    return (labelled.groupBy("Cluster")
            .agg(*[F.round(F.avg(col(c)), round_to).alias(c) for c in features])
            .orderBy("Cluster"))
