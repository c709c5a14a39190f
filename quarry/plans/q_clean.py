"""Registered queries: cleaning, imputation, casts, column edits, order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import columns as K
from quarry.operators import windows as W
from quarry.plans.catalog import EVENTS_DIRTY, events_dirty, register, rounded, table

EV_ALL = "event_id, ts, user_id, event_type, {v} AS value, props"


def _ev(v: str) -> str:
    return EV_ALL.format(v=v)


@register("normalize_missing", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events""")
def q_normalize_missing(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
        .otherwise(F.col("value")).alias("value"))
    return C.normalize_missing(ev)


@register("drop_missing", f"WITH {EVENTS_DIRTY} SELECT * FROM evd WHERE value IS NOT NULL")
def q_drop_missing(spark, sf):
    return C.drop_missing(events_dirty(spark, sf), "value")


@register("complete_cases", f"""WITH {EVENTS_DIRTY}
SELECT * FROM evd WHERE value IS NOT NULL AND event_type IS NOT NULL""")
def q_complete_cases(spark, sf):
    return C.complete_cases(events_dirty(spark, sf), ["event_type", "value"])


@register("fill_mean", f"""WITH {EVENTS_DIRTY}
SELECT {_ev("round(coalesce(value, (SELECT avg(value) FROM evd)), 6)")} FROM evd""")
def q_fill_mean(spark, sf):
    return rounded(C.fill_missing(events_dirty(spark, sf), "value", "mean"), {"value": 6})


@register("fill_median", f"""WITH {EVENTS_DIRTY}
SELECT {_ev("coalesce(value, (SELECT quantile_cont(value, 0.5) FROM evd))")} FROM evd""")
def q_fill_median(spark, sf):
    return C.fill_missing(events_dirty(spark, sf), "value", "median")


@register("fill_mode", f"""WITH {EVENTS_DIRTY},
mo AS (SELECT event_type FROM evd WHERE event_type IS NOT NULL GROUP BY event_type
       ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, ts, user_id, coalesce(event_type, (SELECT event_type FROM mo)) AS event_type,
       value, props FROM evd""")
def q_fill_mode(spark, sf):
    return C.fill_missing(events_dirty(spark, sf), "event_type", "mode")


@register("fill_constant", f"""WITH {EVENTS_DIRTY}
SELECT {_ev("coalesce(value, -1.5)")} FROM evd""")
def q_fill_constant(spark, sf):
    return C.fill_missing(events_dirty(spark, sf), "value", "constant", "-1.5")


@register("forward_fill", f"""WITH {EVENTS_DIRTY}
SELECT {_ev("last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} FROM evd""")
def q_forward_fill(spark, sf):
    return W.forward_fill(events_dirty(spark, sf), "value", ["ts", "event_id"])


@register("forward_fill_by", f"""WITH {EVENTS_DIRTY}
SELECT {_ev("last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} FROM evd""")
def q_forward_fill_by(spark, sf):
    return W.forward_fill(events_dirty(spark, sf), "value", ["ts", "event_id"], ["event_type"])


@register("drop_duplicates", f"WITH {EVENTS_DIRTY} SELECT DISTINCT * FROM evd")
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(events_dirty(spark, sf))


@register("rolling_mean", f"""WITH {EVENTS_DIRTY}
SELECT event_id, ts, value,
       round(CASE WHEN count(value) OVER w >= 7 THEN avg(value) OVER w END, 6) AS value_rolling_7
FROM evd WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean(spark, sf):
    ev = events_dirty(spark, sf).select("event_id", "ts", "value")
    return rounded(W.rolling_mean(ev, "value", ["ts", "event_id"], 7), {"value_rolling_7": 6})


@register("rolling_mean_by", """
SELECT o_orderkey, o_orderstatus, o_totalprice,
       round(CASE WHEN count(o_totalprice) OVER w >= 2 THEN avg(o_totalprice) OVER w END, 6)
         AS avg_price_30
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey
                         ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean_by(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice",
                                          "o_orderdate")
    r = W.rolling_mean(o, "o_totalprice", ["o_orderdate", "o_orderkey"], 30, ["o_orderstatus"],
                       min_periods=2, name="avg_price_30", chunk=1000)
    return rounded(r.drop("o_orderdate"), {"avg_price_30": 6})


@register("ordered_index", """
SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1
  AS row_index FROM orders""")
def q_ordered_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return W.ordered_index(o, ["o_orderdate", "o_orderkey"])


@register("area_stack", """
WITH g AS (SELECT date_trunc('year', o_orderdate) AS yr, o_orderstatus,
                  coalesce(sum(o_totalprice), 0) AS o_totalprice FROM orders GROUP BY 1, 2)
SELECT yr, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
       round(sum(o_totalprice) OVER (PARTITION BY yr ORDER BY o_orderstatus
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS stacked FROM g""")
def q_area_stack(spark, sf):
    o = table(spark, sf, "orders").withColumn("yr", F.date_trunc("year", "o_orderdate"))
    return rounded(W.area_stack(o, "yr", "o_totalprice", "o_orderstatus"),
                   {"o_totalprice": 2, "stacked": 2})


FENCE_SQL = f"""WITH {EVENTS_DIRTY},
f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
             count(value) AS n FROM evd)"""


@register("iqr_fences", FENCE_SQL + """
SELECT 'value' AS column, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM f""")
def q_iqr_fences(spark, sf):
    return rounded(C.iqr_fences(events_dirty(spark, sf), ["value"]),
                   {k: 6 for k in ("q1", "q3", "iqr", "lower", "upper")})


@register("outliers", FENCE_SQL + """
SELECT evd.* FROM evd, f WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def q_outliers(spark, sf):
    return C.outliers(events_dirty(spark, sf), "value")


@register("outliers_flag", FENCE_SQL + """
SELECT evd.*, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false)
  AS is_outlier FROM evd, f""")
def q_outliers_flag(spark, sf):
    return C.outliers(events_dirty(spark, sf), "value", flag="is_outlier")


@register("drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def q_drop_columns(spark, sf):
    return K.drop_columns(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@register("rename", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price,
  o_orderdate, o_orderpriority FROM orders""")
def q_rename(spark, sf):
    return K.rename(table(spark, sf, "orders"), "o_totalprice", "total_price")


def _texts(spark, sf):
    p = table(spark, sf, "part")
    junk = F.col("p_partkey") % 9 == 0
    return p.select(
        "p_partkey",
        F.when(junk, F.lit("x")).otherwise(F.col("p_size").cast("string")).alias("size_txt"),
        F.when(junk, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
        .alias("price_txt"),
        F.when(junk, F.lit("soon")).otherwise(
            F.date_format(F.make_date(F.lit(2024), (F.col("p_partkey") % 12) + 1,
                                      (F.col("p_partkey") % 28) + 1), "yyyy-MM-dd"))
        .alias("date_txt"),
        "p_size", "p_brand")


TEXTS_SQL = """WITH t AS (SELECT p_partkey,
  CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS size_txt,
  CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS price_txt,
  CASE WHEN p_partkey % 9 = 0 THEN 'soon'
       ELSE strftime(make_date(2024, CAST(p_partkey % 12 + 1 AS INTEGER),
                               CAST(p_partkey % 28 + 1 AS INTEGER)), '%Y-%m-%d') END AS date_txt,
  p_size, p_brand FROM part)"""


@register("cast_int", TEXTS_SQL + " SELECT p_partkey, TRY_CAST(size_txt AS BIGINT) AS size_txt FROM t")
def q_cast_int(spark, sf):
    return K.cast_column(_texts(spark, sf).select("p_partkey", "size_txt"), "size_txt", "int64")


@register("cast_float", TEXTS_SQL + " SELECT p_partkey, TRY_CAST(price_txt AS DOUBLE) AS price_txt FROM t")
def q_cast_float(spark, sf):
    return K.cast_column(_texts(spark, sf).select("p_partkey", "price_txt"), "price_txt", "float64")


@register("cast_datetime",
          TEXTS_SQL + " SELECT p_partkey, TRY_CAST(date_txt AS TIMESTAMP) AS date_txt FROM t")
def q_cast_datetime(spark, sf):
    return K.cast_column(_texts(spark, sf).select("p_partkey", "date_txt"), "date_txt", "datetime")


# Dates of four written forms, one of them a time of day without a date.
WRITTEN = ("dd.MM.yyyy", "MMM d, yyyy", "MMMM d, yyyy hh:mm a", "HH:mm")


@register("cast_datetime_written", """SELECT o_orderkey,
  CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS TIMESTAMP) END AS written FROM orders""")
def q_cast_datetime_written(spark, sf):
    o = table(spark, sf, "orders")
    forms = [F.when(F.col("o_orderkey") % 4 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(WRITTEN)]
    return K.cast_column(o.select("o_orderkey", F.coalesce(*forms).alias("written")), "written", "datetime")


@register("cast_str", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def q_cast_str(spark, sf):
    return K.cast_column(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "str")


@register("cast_category", "SELECT p_partkey, p_brand FROM part")
def q_cast_category(spark, sf):
    return K.cast_column(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand",
                         "category")


@register("category_codes", """
SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_code FROM part""")
def q_category_codes(spark, sf):
    return K.category_codes(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


@register("calc_column", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS "net price"
FROM lineitem""")
def q_calc_column(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                             "l_discount")
    out = K.add_column(li, "net price", "`l_extendedprice` * (1 - l_discount)")
    return rounded(out.select("l_orderkey", "l_linenumber", "`net price`"), {"net price": 4})


@register("numeric_projection", """
SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem""")
def q_numeric_projection(spark, sf):
    return K.numeric_projection(table(spark, sf, "lineitem"), 3, "l_returnflag")


def _geo(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_acctbal",
                    ((F.col("c_custkey") % 170) - 85.0).alias("lat"),
                    (((F.col("c_nationkey") * 37 + F.col("c_custkey")) % 360) - 180.0).alias("lon"))


GEO_SQL = """WITH g AS (SELECT c_custkey, c_name, c_acctbal, (c_custkey % 170) - 85.0 AS lat,
  ((c_nationkey * 37 + c_custkey) % 360) - 180.0 AS lon FROM customer)"""


@register("map_points", GEO_SQL + " SELECT lat, lon, c_name, c_acctbal FROM g")
def q_map_points(spark, sf):
    return K.map_points(_geo(spark, sf), "lat", "lon", hover="c_name", size="c_acctbal")


@register("map_points_grid", GEO_SQL + """
SELECT floor(lat / 10.0) * 10.0 AS cell_lat, floor(lon / 10.0) * 10.0 AS cell_lon,
       count(*) AS points, round(sum(c_acctbal), 2) AS size FROM g GROUP BY 1, 2""")
def q_map_points_grid(spark, sf):
    return rounded(K.map_points(_geo(spark, sf), "lat", "lon", size="c_acctbal", grid=10.0),
                   {"size": 2})


@register("choropleth", """
SELECT n_name, round(sum(c_acctbal), 2) AS c_acctbal FROM customer
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def q_choropleth(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"),
                                          F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(K.choropleth(c, "n_name", "c_acctbal", "sum"), {"c_acctbal": 2})
