"""Registered queries: missing values as NaN, typed pivot keys, each chart kind, text through
CSV, report tables, separated clusters and rolling means over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import kinds as KD
from quarry.operators import aggregate as A
from quarry.operators import bins as B
from quarry.operators import fit as T
from quarry.operators import pivot as PV
from quarry.operators import profile as P
from quarry.operators import windows as W
from quarry.plans import spec as S
from quarry.plans.catalog import (EVENTS_DIRTY, LINEITEM_DIRTY, events_dirty, register, rounded,
                                  table)
from quarry.plans.q_charts import _h2_sql, _hist_sql, _scratch, violin_sql
from quarry.plans.q_pivot import pivot_sql
from quarry.plans.q_profile import _describe_sql
from quarry.sources import io as IO

# ---- NaN beside NULL: l_discount is NULL or NaN by order, l_tax NaN by order ----

NAN_CTE = """
lid AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity,
               CASE WHEN l_orderkey % 5 > 1 THEN l_discount END AS l_discount,
               CASE WHEN l_orderkey % 3 > 0 THEN l_tax END AS l_tax FROM lineitem)
"""


def _nan(spark, sf):
    nan = F.lit(float("nan"))
    part = F.col("l_orderkey") % 5
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity",
        F.when(part > 1, F.col("l_discount")).when(part == 1, nan).alias("l_discount"),
        F.when(F.col("l_orderkey") % 3 > 0, F.col("l_tax")).otherwise(nan).alias("l_tax"))


def _nan_group(agg: str, sql: str) -> None:
    def fn(spark, sf):
        return rounded(A.group_agg(_nan(spark, sf), "l_returnflag", "l_discount", agg),
                       {"l_discount": 6})
    register(f"nan_group_agg_{agg}", f"WITH {NAN_CTE} SELECT l_returnflag, round({sql}, 6) AS l_discount "
             "FROM lid GROUP BY l_returnflag")(fn)


for _agg, _sql in (("sum", "coalesce(sum(l_discount), 0)"), ("mean", "avg(l_discount)"),
                   ("count", "count(l_discount)"), ("max", "max(l_discount)"),
                   ("median", "quantile_cont(l_discount, 0.5)")):
    _nan_group(_agg, _sql)


@register("nan_correlation", f"WITH {NAN_CTE}, c AS (SELECT round(corr(l_discount, l_tax), 6) AS dt, "
          "round(corr(l_discount, l_quantity), 6) AS dq, round(corr(l_tax, l_quantity), 6) AS tq FROM lid) "
          + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {v} AS r FROM c" for a, b, v in (
              ("l_discount", "l_tax", "dt"), ("l_discount", "l_quantity", "dq"),
              ("l_quantity", "l_tax", "tq"))))
def q_nan_correlation(spark, sf):
    r = A.correlation(_nan(spark, sf), ["l_discount", "l_tax", "l_quantity"])
    return rounded(r.where(F.col("a") < F.col("b")), {"r": 6})


@register("nan_pivot", pivot_sql("l_returnflag", "l_linestatus", ["F", "O"], ["l_discount"], "sum")
          .replace(LINEITEM_DIRTY, NAN_CTE))
def q_nan_pivot(spark, sf):
    return PV.pivot(_nan(spark, sf), ["l_returnflag"], ["l_linestatus"], ["l_discount"], "sum")


@register("nan_value_counts", f"WITH {NAN_CTE} SELECT l_tax, count(*) AS count FROM lid "
          "WHERE l_tax IS NOT NULL GROUP BY l_tax")
def q_nan_value_counts(spark, sf):
    return A.value_counts(_nan(spark, sf), "l_tax")


@register("nan_rolling_mean", f"""WITH {NAN_CTE} SELECT l_orderkey, l_linenumber,
  round(CASE WHEN count(l_discount) OVER w >= 2 THEN avg(l_discount) OVER w END, 6) AS l_discount_rolling_9
  FROM lid WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)""")
def q_nan_rolling_mean(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    r = W.rolling_mean(_nan(spark, sf), "l_discount", order, 9, min_periods=2)
    return rounded(r.select("l_orderkey", "l_linenumber", "l_discount_rolling_9"),
                   {"l_discount_rolling_9": 6})


@register("nan_duplicates", f"""WITH {NAN_CTE} SELECT (SELECT count(*) FROM lid)
  - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_discount, l_tax FROM lid)) AS duplicates""")
def q_nan_duplicates(spark, sf):
    return P.duplicate_count(_nan(spark, sf).select("l_returnflag", "l_discount", "l_tax"))


# ---- pivots by typed keys ----

def _typed_pivot(name: str, keys: dict, names: list[tuple[str, str]]) -> None:
    """Pivot of summed quantity by derived keys; ``names`` are (SQL condition, column name)."""
    cells = ", ".join(f'round(sum(l_quantity) FILTER (WHERE {c}), 2) AS "{n}"' for c, n in names)
    cells += ', round(sum(l_quantity), 2) AS "Total"'

    def fn(spark, sf):
        li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity",
                                                 *[F.expr(e).alias(k) for k, e in keys.items()])
        return PV.pivot(li, ["l_returnflag"], list(keys), ["l_quantity"], "sum")
    register(name, f"SELECT l_returnflag, {cells} FROM lineitem GROUP BY l_returnflag "
             f"UNION ALL SELECT 'Total', {cells} FROM lineitem")(fn)


def _by_status(f: str, o: str) -> str:
    return f"CASE WHEN l_linestatus = 'F' THEN {f} ELSE {o} END"


_F, _O = "l_linestatus = 'F'", "l_linestatus <> 'F'"
_typed_pivot("pivot_boolean_key", {"k": _F}, [(_O, "False"), (_F, "True")])
_typed_pivot("pivot_double_key", {"k": _by_status("1e7D", "2.5e-5D")},
             [(_O, "2.5e-05"), (_F, "10000000.0")])
_typed_pivot("pivot_timestamp_key",
             {"k": _by_status("timestamp_ntz'2024-01-01 00:00:00.25'", "timestamp_ntz'2024-01-02 00:00:00'")},
             [(_F, "2024-01-01 00:00:00.25"), (_O, "2024-01-02 00:00:00")])
_typed_pivot("pivot_joined_keys", {"k1": _by_status("'a_b'", "'a'"), "k2": _by_status("'c'", "'b_c'")},
             [(_O, "a_b_c"), (_F, "a_b_c (2)")])
_typed_pivot("pivot_key_total", {"k": _by_status("'Total'", "'x'")}, [(_F, "Total (2)"), (_O, "x")])


@register("pivot_long", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 'Total', round(sum(l_quantity), 2) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'Total', l_linestatus, round(sum(l_quantity), 2) FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'Total', 'Total', round(sum(l_quantity), 2) FROM lineitem""")
def q_pivot_long(spark, sf):
    return PV.pivot_long(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_quantity"])


@register("crosstab_boolean", """SELECT l_returnflag, count(*) FILTER (WHERE l_quantity <= 25) AS "False",
  count(*) FILTER (WHERE l_quantity > 25) AS "True" FROM lineitem GROUP BY l_returnflag""")
def q_crosstab_boolean(spark, sf):
    li = table(spark, sf, "lineitem")
    return A.crosstab(li.select("l_returnflag", (F.col("l_quantity") > 25).alias("big")),
                      "l_returnflag", "big")


# ---- one query per chart kind ----

def _chart(name: str, tbl: str, spec: dict, sql: str, digits: dict | None = None, cols=None) -> None:
    def fn(spark, sf):
        df = table(spark, sf, tbl)
        out = S.run_spec(df.select(*cols) if cols else df, spec)
        return rounded(out, digits) if digits else out
    register(f"run_spec_{name}", sql)(fn)


def _spec(kind, x, y=None, color=None, agg=None, top=None):
    return {"chart_type": kind, "x_col": x, "y_col": y, "color_by": color, "aggregation": agg,
            "top_n": top}


_QP = ["l_quantity", "l_extendedprice"]
_chart("top", "part", _spec("Bar Chart (Top N)", "p_name"),
       "SELECT p_name, count(*) AS count FROM part GROUP BY p_name ORDER BY count DESC, p_name LIMIT 20")
_chart("bar_top_n", "part", _spec("Bar", "p_brand", "p_retailprice", top=7),
       "SELECT p_brand, round(sum(p_retailprice), 2) AS p_retailprice FROM part GROUP BY p_brand "
       "ORDER BY 2 DESC, 1 LIMIT 7", {"p_retailprice": 2})
_chart("line", "orders", _spec("Line", "o_orderdate", "o_totalprice", agg="mean"),
       "SELECT o_orderdate, o_totalprice FROM orders")
_chart("line_color", "orders", _spec("Line Chart", "o_orderdate", "o_totalprice", "o_orderstatus", "max"),
       "SELECT o_orderdate, o_orderstatus, o_totalprice FROM orders")
_chart("line_top_n", "orders", _spec("Line", "o_orderdate", "o_totalprice", agg="mean", top=12),
       "SELECT o_orderdate, round(avg(o_totalprice), 8) AS o_totalprice FROM orders GROUP BY o_orderdate "
       "ORDER BY avg(o_totalprice) DESC, o_orderdate LIMIT 12", {"o_totalprice": 8})
_chart("area", "orders", _spec("Area", "o_orderdate", "o_totalprice"),
       "SELECT o_orderdate, o_totalprice FROM orders")
_chart("area_color", "orders", _spec("Area Chart", "o_orderdate", "o_totalprice", "o_orderstatus"),
       "SELECT o_orderdate, o_orderstatus, o_totalprice, round(o_totalprice + coalesce(under, 0), 2) AS stacked FROM orders "
       "JOIN (SELECT o_orderdate, o_orderstatus, sum(v) OVER (PARTITION BY o_orderdate ORDER BY o_orderstatus "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM (SELECT o_orderdate, o_orderstatus, "
       "sum(o_totalprice) AS v FROM orders GROUP BY ALL)) USING (o_orderdate, o_orderstatus)", {"stacked": 2})


def _pie_sql(limit: str) -> str:
    return ("WITH vc AS (SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, "
            f"p_brand {limit}) SELECT p_brand, count, round(count / sum(count) OVER (), 6) AS share FROM vc")


_chart("pie_short", "part", _spec("Pie", "p_brand"), _pie_sql("LIMIT 10"), {"share": 6})
_chart("pie_brand", "part", _spec("Pie Chart", "p_brand"), _pie_sql("LIMIT 12"), {"share": 6})
_chart("treemap", "part", _spec("Treemap", "p_brand"), _pie_sql(""), {"share": 6})
_chart("pie_y", "part", _spec("Pie", "p_brand", "p_retailprice"),
       "SELECT p_brand, round(sum(p_retailprice), 2) AS p_retailprice FROM part GROUP BY p_brand",
       {"p_retailprice": 2})
_chart("scatter", "lineitem", _spec("Scatter", *_QP),
       "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, "
       "l_quantity) AS i FROM lineitem) SELECT l_quantity, l_extendedprice, round(s * l_quantity + i, 4) AS fit "
       "FROM lineitem, f", {"fit": 4})
_chart("scatter_color", "lineitem", _spec("Scatter Plot", *_QP, "l_returnflag"),
       "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
for _kind, _n, _name in (("Pair Plot", 5, "pair"), ("Parallel Coordinates", 8, "parallel"),
                         ("3D Scatter", 3, "scatter3d")):
    _num = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"][:_n]
    _chart(_name, "lineitem", _spec(_kind, None), f"SELECT {', '.join(_num)} FROM lineitem")
    _chart(f"{_name}_color", "lineitem", _spec(_kind, None, None, "l_returnflag"),
           f"SELECT {', '.join(_num)}, l_returnflag FROM lineitem")
_chart("strip", "lineitem", _spec("Strip Plot", "l_returnflag", "l_quantity"),
       "SELECT l_quantity FROM lineitem")
_chart("strip_color", "lineitem", _spec("Strip Plot", "l_returnflag", "l_quantity", "l_returnflag"),
       "SELECT l_quantity, l_returnflag FROM lineitem")
_chart("histogram", "events", _spec("Histogram", "value"), _hist_sql("events", "value", 30),
       {"lower": 6, "upper": 6})
_chart("histogram_color", "events", _spec("Histogram", "value", None, "event_type"),
       _hist_sql("events", "value", 30, "event_type"), {"lower": 6, "upper": 6})
_chart("histogram_text", "part", _spec("Histogram", "p_brand"),
       "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand")
_chart("density", "events", _spec("Density Plot", "value", None, "event_type"),
       _hist_sql("events", "value", 40, "event_type", dens=True), {"lower": 6, "upper": 6, "density": 6})
_chart("hexbin", "lineitem", _spec("Hexbin", *_QP), _h2_sql(None))
_chart("density2d_color", "lineitem", _spec("2D Density", *_QP, "l_returnflag"), _h2_sql("l_returnflag"))
_chart("heatmap_counts", "orders", _spec("Heatmap (Counts)", "o_orderpriority", "o_orderstatus"),
       "SELECT o_orderpriority, " + ", ".join(
           f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP")
       + " FROM orders GROUP BY o_orderpriority")
_chart("heatmap", "lineitem", _spec("Heatmap", None), " UNION ALL ".join(
    f"SELECT '{a}' AS \"column\", " + ", ".join(f"round(corr({a}, {b}), 6) AS {b}" for b in _QP)
    + " FROM lineitem" for a in _QP), {c: 6 for c in _QP}, _QP)
_BOX = """SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type"""
_WHISK = f"""WITH q AS ({_BOX}) SELECT event_type, q1, median, q3,
  min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
  max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS upper_whisker
  FROM events JOIN q USING (event_type) GROUP BY ALL"""
_chart("violin", "events", _spec("Violin Plot", "event_type", "value", "event_type"),
       f"WITH v AS ({violin_sql('events', 'value', 'event_type')}), w AS ({_WHISK}) SELECT event_type, y, density, "
       "round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, lower_whisker, upper_whisker "
       "FROM v JOIN w USING (event_type)", {"y": 6, "density": 8, "q1": 6, "median": 6, "q3": 6})
_chart("box", "events", _spec("Box", "event_type", "value", "event_type"),
       f"WITH w AS ({_WHISK}) SELECT event_type, count(*) AS n, min(value) AS min, round(q1, 6) AS q1, "
       "round(median, 6) AS median, round(q3, 6) AS q3, max(value) AS max, lower_whisker, upper_whisker, "
       "count(*) FILTER (WHERE value < lower_whisker OR value > upper_whisker) AS outliers "
       "FROM events JOIN w USING (event_type) GROUP BY event_type, w.q1, w.median, w.q3, lower_whisker, "
       "upper_whisker", {"q1": 6, "median": 6, "q3": 6})


@register("rug", "SELECT value, count(*) AS count FROM events GROUP BY value")
def q_rug(spark, sf):
    return B.rug(table(spark, sf, "events"), "value")


@register("answer_scatter", _describe_sql("lineitem", _QP))
def q_answer_scatter(spark, sf):
    return S.answer(table(spark, sf, "lineitem"), "scatter", *_QP)


@register("answer_histogram", _hist_sql("lineitem", "l_extendedprice", 30))
def q_answer_histogram(spark, sf):
    return rounded(S.answer(table(spark, sf, "lineitem"), "histogram", "l_extendedprice"),
                   {"lower": 6, "upper": 6})


@register("line_rows", "SELECT o_orderdate, o_totalprice FROM orders")
def q_line_rows(spark, sf):
    return A.line(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


# ---- text through files, report tables, kinds ----

def _csv(name: str) -> None:
    def fn(spark, sf):
        path = _scratch(spark, "csv")
        IO.write_csv(table(spark, sf, name), path)
        return IO.read_csv(spark, path)
    register(f"csv_roundtrip_{name}", f"SELECT * FROM {name}")(fn)


for _t in ("documents", "conversations"):
    _csv(_t)


@register("report_data", "SELECT * FROM customer")
def q_report_data(spark, sf):
    return spark.read.parquet(IO.write_report(table(spark, sf, "customer"), _scratch(spark, "report"))["data"])


@register("report_frames_describe", _describe_sql("lineitem", _QP))
def q_report_frames_describe(spark, sf):
    return IO.report_frames(table(spark, sf, "lineitem").select(*_QP))["describe"]


@register("digest_sample", """SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name,
  CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation ORDER BY nation.n_nationkey LIMIT 5""")
def q_digest_sample(spark, sf):
    return S.digest(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), 5,
                    ["n_nationkey"])["sample"]


@register("grouping_columns", """SELECT 'l_linenumber' AS "column", count(DISTINCT l_linenumber) AS "unique" FROM lineitem
UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem""")
def q_grouping_columns(spark, sf):
    return P.grouping_columns(table(spark, sf, "lineitem"))


@register("select_kind", "SELECT o_orderdate, o_orderstatus, o_orderpriority FROM orders")
def q_select_kind(spark, sf):
    return KD.select_kind(table(spark, sf, "orders"), "categorical", "datetime")


# ---- rolling mean over time, separated clusters ----

@register("rolling_mean_time", f"""WITH {EVENTS_DIRTY} SELECT event_id, ts, value, round(avg(value) OVER (
  ORDER BY ts RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW), 10) AS hour_mean FROM evd""")
def q_rolling_mean_time(spark, sf):
    ev = events_dirty(spark, sf).select("event_id", "ts", "value")
    return rounded(W.rolling_mean_time(ev, "value", "ts", 3600, name="hour_mean"), {"hour_mean": 10})


@register("rolling_mean_time_by", f"""WITH {EVENTS_DIRTY} SELECT event_id, event_type, round(CASE WHEN
  count(value) OVER w >= 3 THEN avg(value) OVER w END, 10) AS day_mean FROM evd WINDOW w AS (
  PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW)""")
def q_rolling_mean_time_by(spark, sf):
    r = W.rolling_mean_time(events_dirty(spark, sf), "value", "ts", 86400, ["event_type"], 3, "day_mean")
    return rounded(r.select("event_id", "event_type", "day_mean"), {"day_mean": 10})


BLOBS = """bl AS (SELECT l_orderkey, l_linenumber, 'C' || (l_orderkey % 4 + 1) AS "Cluster",
  (l_orderkey % 4) * 1000 + l_quantity AS fx, (3 - l_orderkey % 4) * 500 + l_linenumber * 1.0 AS fy FROM lineitem)"""


def _blobs(spark, sf):
    b = F.col("l_orderkey") % 4
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             (b * 1000 + F.col("l_quantity")).alias("fx"),
                                             ((3 - b) * 500 + F.col("l_linenumber") * 1.0).cast("double").alias("fy"))
    return T.kmeans(li, ["fx", "fy"], k=4)


@register("kmeans_blob_labels", f'WITH {BLOBS} SELECT l_orderkey, l_linenumber, "Cluster" FROM bl')
def q_kmeans_blob_labels(spark, sf):
    return _blobs(spark, sf).select("l_orderkey", "l_linenumber", "Cluster")


@register("kmeans_blob_sizes", f'WITH {BLOBS} SELECT "Cluster", count(*) AS "Count" FROM bl GROUP BY ALL')
def q_kmeans_blob_sizes(spark, sf):
    return T.cluster_sizes(_blobs(spark, sf))


@register("kmeans_blob_means", f'WITH {BLOBS} SELECT "Cluster", round(avg(fx), 2) AS fx, round(avg(fy), 2) AS fy '
          'FROM bl GROUP BY ALL')
def q_kmeans_blob_means(spark, sf):
    return T.cluster_means(_blobs(spark, sf), ["fx", "fy"])
