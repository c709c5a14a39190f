"""Data-quality alerts, their totals, and per-column recommendations.

Rules, in this order (all comparisons strict):

* numeric column with at least 4 present values and a non-zero IQR (else skipped, skew test
  included): outliers outside the 1.5 IQR fence -> critical above 10 %, else warning;
  |sample-adjusted skew| > 2 -> warning;
* every column: missing > 30 % -> critical; 5 % < missing <= 30 % -> warning;
* the table: duplicate rows -> warning on column "Dataset".

Three aggregate jobs whatever the number of columns: one fused aggregate of counts and
moments, the distributed exact quartiles, one outlier count against the broadcast fences;
plus the duplicate count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import col, missing, nan_to_null, numeric_columns
from quarry.functions.quantiles import quantiles_long, stack_columns
from quarry.operators.profile import constant_columns, duplicate_count

# Alert thresholds.
MIN_VALUES = 4
OUTLIER_CRITICAL_PCT = 10
SKEW_LIMIT = 2
MISSING_CRITICAL_PCT = 30
MISSING_WARNING_PCT = 5
SCHEMA = "order int, severity string, column string, issue string, detail string, value double"


def numeric_checks(df: DataFrame) -> DataFrame:
    """Per numeric column: ``column, n, q1, q3, outliers, pct, skew, checked``."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, n long, q1 double, q3 double, outliers long, pct double, "
                "skew double, checked boolean")
    long_df = stack_columns(df, cols).withColumn("value", nan_to_null(F.col("value"))) \
        .where(F.col("value").isNotNull())
    v = F.col("value")
    n = F.count(v).cast("double")
    mom = long_df.groupBy("column").agg(
        F.count(v).alias("n"),
        F.when(n >= 3, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    q = quantiles_long(long_df, ["column"], "value", [0.25, 0.75])
    qw = q.groupBy("column").agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                 F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = qw.select("column", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("_lo"),
                       (F.col("q3") + 1.5 * iqr).alias("_hi"))
    # one row per numeric column: bounded by the schema, so broadcasting it is safe
    out = (long_df.join(F.broadcast(fences), "column")
           .groupBy("column", "q1", "q3")
           .agg(F.count_if((v < F.col("_lo")) | (v > F.col("_hi"))).alias("outliers")))
    j = mom.join(out, "column", "left")
    checked = (F.col("n") >= MIN_VALUES) & (F.col("q3") != F.col("q1"))
    return j.select("column", "n", "q1", "q3", "outliers",
                    (F.col("outliers") * 100.0 / F.col("n")).alias("pct"), "skew",
                    checked.alias("checked"))


def missing_shares(df: DataFrame) -> DataFrame:
    """``column, pct`` missing share of every column (one aggregate)."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                     F.coalesce(F.try_divide(F.col(f"m{i}") * 100.0, F.col("_rows")), F.lit(0.0)).alias("pct"))
            for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*rows)))


def alerts(df: DataFrame) -> DataFrame:
    """Alerts table ``severity, column, issue, detail, value`` in rule order."""
    pos = {c: i for i, c in enumerate(df.columns)}
    num = numeric_checks(df).where(F.col("checked"))
    posmap = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    pct1 = F.round(F.col("pct"), 1).cast("string")
    # both checks of a column from one row of the checks table
    pair = F.array(
        F.struct((posmap[F.col("column")] * 10).alias("order"),
                 F.when(F.col("pct") > OUTLIER_CRITICAL_PCT, "critical").otherwise("warning")
                 .alias("severity"),
                 F.col("column"), F.lit("Outliers (IQR)").alias("issue"),
                 F.concat(F.col("outliers").cast("string"), F.lit(" values ("), pct1,
                          F.lit("%) outside IQR fence")).alias("detail"),
                 F.when(F.col("outliers") > 0, F.round(F.col("pct"), 4)).alias("value")),
        F.struct((posmap[F.col("column")] * 10 + 1).alias("order"), F.lit("warning").alias("severity"),
                 F.col("column"), F.lit("High skewness").alias("issue"),
                 F.concat(F.lit("skew = "), F.round(F.col("skew"), 2).cast("string"),
                          F.lit(" — consider log transform")).alias("detail"),
                 F.when(F.abs(F.col("skew")) > SKEW_LIMIT, F.round(F.col("skew"), 4)).alias("value")))
    numeric = num.select(F.inline(pair)).where(F.col("value").isNotNull())
    ms = missing_shares(df)
    base = 10 * (len(pos) + 1)
    miss = ms.where(F.col("pct") > MISSING_WARNING_PCT).select(
        (F.lit(base) + F.col("pos")).alias("order"),
        F.when(F.col("pct") > MISSING_CRITICAL_PCT, "critical").otherwise("warning")
        .alias("severity"), "column",
        F.when(F.col("pct") > MISSING_CRITICAL_PCT, "High missing %").otherwise("Missing values")
        .alias("issue"),
        F.concat(F.round(F.col("pct"), 1).cast("string"), F.lit("% missing")).alias("detail"),
        F.round(F.col("pct"), 4).alias("value"))
    dup = duplicate_count(df).where(F.col("duplicates") > 0).select(
        F.lit(base + len(pos)).alias("order"), F.lit("warning").alias("severity"),
        F.lit("Dataset").alias("column"), F.lit("Duplicates").alias("issue"),
        F.concat(F.col("duplicates").cast("string"), F.lit(" duplicate rows")).alias("detail"),
        F.col("duplicates").cast("double").alias("value"))
    allr = numeric.unionByName(miss).unionByName(dup)
    return allr.orderBy("order").drop("order")


def alert_totals(alerts_df: DataFrame) -> DataFrame:
    """``total, critical, warnings`` of an alerts table (one row)."""
    return alerts_df.agg(F.count(F.lit(1)).alias("total"),
                         F.count_if(F.col("severity") == "critical").alias("critical"),
                         F.count_if(F.col("severity") == "warning").alias("warnings"))


def recommend(df: DataFrame) -> DataFrame:
    """Per column: ``column, action, reason``: drop (missing > 30 % or constant), impute
    (missing > 5 %), flag (IQR outliers), else keep."""
    ms = missing_shares(df)
    const = constant_columns(df)
    num = numeric_checks(df).select("column", F.when(F.col("checked"), F.col("outliers"))
                                    .alias("outliers"))
    j = ms.join(const, "column", "left").join(num, "column", "left")
    action = (F.when(F.col("pct") > MISSING_CRITICAL_PCT, "drop")
              .when(F.col("constant"), "drop")
              .when(F.col("pct") > MISSING_WARNING_PCT, "impute")
              .when(F.coalesce(F.col("outliers"), F.lit(0)) > 0, "flag")
              .otherwise("keep"))
    reason = (F.when(F.col("pct") > MISSING_CRITICAL_PCT, "high missing share")
              .when(F.col("constant"), "constant column")
              .when(F.col("pct") > MISSING_WARNING_PCT, "missing values")
              .when(F.coalesce(F.col("outliers"), F.lit(0)) > 0, "IQR outliers")
              .otherwise("no issue"))
    return j.orderBy("pos").select("column", action.alias("action"), reason.alias("reason"))
