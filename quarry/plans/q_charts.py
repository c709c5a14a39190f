"""Registered queries: bins, box/violin, points, fits, k-means, alerts, chart specs, I/O."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import alerts as AL
from quarry.operators import bins as B
from quarry.operators import fit as T
from quarry.plans import spec as S
from quarry.plans.catalog import (EVENTS_DIRTY, events_dirty, register, rounded, table)
from quarry.session import checkpoint_dir
from quarry.sources import io as IO


def _hist_sql(src: str, x: str, bins: int, color: str | None = None, dens: bool = False) -> str:
    ck = f"{color}, " if color else ""
    d = (", round(count(*) / CASE WHEN w > 0 THEN w ELSE 1.0 END, 6) AS density"
         if dens else "")
    return f"""WITH r AS (SELECT min({x}) AS lo, max({x}) AS hi, (max({x}) - min({x})) / {bins} AS w
                FROM {src}),
b AS (SELECT {ck}CAST(CASE WHEN w > 0 THEN least(floor(({x} - lo) / w), {bins - 1}) ELSE 0 END
             AS INTEGER) AS bin, lo, w FROM {src}, r WHERE {x} IS NOT NULL)
SELECT {ck}bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper,
       count(*) AS count{d} FROM b GROUP BY {ck}bin, lo, w"""


def _hist_round(df, dens=False):
    return rounded(df, {"lower": 6, "upper": 6, **({"density": 6} if dens else {})})


@register("histogram", _hist_sql("events", "value", 30))
def q_histogram(spark, sf):
    return _hist_round(B.histogram(table(spark, sf, "events"), "value", 30))


@register("histogram_color", _hist_sql("events", "value", 30, "event_type"))
def q_histogram_color(spark, sf):
    return _hist_round(B.histogram(table(spark, sf, "events"), "value", 30, "event_type"))


@register("density", _hist_sql("lineitem", "l_extendedprice", 40, dens=True))
def q_density(spark, sf):
    return _hist_round(B.density(table(spark, sf, "lineitem"), "l_extendedprice", 40), True)


def _h2_sql(color: str | None) -> str:
    ck = f"{color}, " if color else ""
    return f"""WITH r AS (SELECT min(l_quantity) AS xlo, (max(l_quantity) - min(l_quantity)) / 20 AS xw,
  min(l_extendedprice) AS ylo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS yw FROM lineitem)
SELECT {ck}CAST(CASE WHEN xw > 0 THEN least(floor((l_quantity - xlo) / xw), 19) ELSE 0 END AS INTEGER) AS bx,
       CAST(CASE WHEN yw > 0 THEN least(floor((l_extendedprice - ylo) / yw), 19) ELSE 0 END AS INTEGER) AS by,
       count(*) AS count FROM lineitem, r GROUP BY ALL"""


@register("hist2d", _h2_sql(None))
def q_hist2d(spark, sf):
    return B.hist2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("hist2d_color", _h2_sql("l_returnflag"))
def q_hist2d_color(spark, sf):
    return B.hist2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                    color="l_returnflag")


@register("box_stats", f"""WITH {EVENTS_DIRTY},
d AS (SELECT event_type, value FROM evd WHERE event_type IS NOT NULL AND value IS NOT NULL),
q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3 FROM d GROUP BY event_type),
j AS (SELECT d.event_type, value, q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo,
             q3 + 1.5 * (q3 - q1) AS hi FROM d JOIN q USING (event_type))
SELECT event_type, count(*) AS n, min(value) AS min, round(q1, 6) AS q1, round(med, 6) AS median,
       round(q3, 6) AS q3, max(value) AS max,
       min(value) FILTER (WHERE value >= lo AND value <= hi) AS lower_whisker,
       max(value) FILTER (WHERE value >= lo AND value <= hi) AS upper_whisker,
       count(*) FILTER (WHERE NOT (value >= lo AND value <= hi)) AS outliers
FROM j GROUP BY event_type, q1, med, q3""")
def q_box_stats(spark, sf):
    return rounded(B.box_stats(events_dirty(spark, sf), "value", "event_type"),
                   {"q1": 6, "median": 6, "q3": 6})


@register("box_stats_all", """
WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS med,
                  quantile_cont(n_chars, 0.75) AS q3 FROM documents),
j AS (SELECT n_chars AS v, q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM documents, q)
SELECT count(*) AS n, min(v)::DOUBLE AS min, round(q1, 6) AS q1, round(med, 6) AS median,
       round(q3, 6) AS q3, max(v)::DOUBLE AS max,
       (min(v) FILTER (WHERE v >= lo AND v <= hi))::DOUBLE AS lower_whisker,
       (max(v) FILTER (WHERE v >= lo AND v <= hi))::DOUBLE AS upper_whisker,
       count(*) FILTER (WHERE NOT (v >= lo AND v <= hi)) AS outliers FROM j GROUP BY q1, med, q3""")
def q_box_stats_all(spark, sf):
    return rounded(B.box_stats(table(spark, sf, "documents"), "n_chars"),
                   {"q1": 6, "median": 6, "q3": 6})


def violin_sql(src: str, y: str, by: str) -> str:
    return f"""WITH st AS (SELECT {by}, count({y}) AS n, min({y}) AS lo, coalesce(stddev_samp({y}), 0) AS sd,
  quantile_cont({y}, 0.75) - quantile_cont({y}, 0.25) AS iqr FROM {src} GROUP BY {by}),
h0 AS (SELECT *, 0.9 * (CASE WHEN iqr > 0 AND iqr / 1.34 < sd THEN iqr / 1.34 ELSE sd END)
  * pow(n, -0.2) AS h1 FROM st),
h AS (SELECT *, CASE WHEN h1 > 0 THEN h1 ELSE 1.0 END AS h FROM h0),
b AS (SELECT {by}, lo, h, n, CAST(floor(({y} - lo) / (h / 4)) AS BIGINT) AS b, count(*) AS c
  FROM {src} JOIN h USING ({by}) GROUP BY ALL)
SELECT {by}, round(lo + (b + d + 0.5) * h / 4, 6) AS y,
  round(sum(c * exp(-0.5 * (d / 4.0) * (d / 4.0))) / (n * h * sqrt(2 * pi())), 8) AS density
FROM b, range(-16, 17) r(d) GROUP BY {by}, lo, h, n, b + d"""


@register("violin", violin_sql("events", "value", "event_type"))
def q_violin(spark, sf):
    return rounded(B.violin(table(spark, sf, "events"), "value", "event_type"), {"y": 6, "density": 8})


@register("points", """
SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_returnflag ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber)),
  l_orderkey, l_linenumber) <= 500""")
def q_points(spark, sf):
    return B.points(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                    "l_returnflag", max_points=500, key=["l_orderkey", "l_linenumber"])


@register("points_all", "SELECT l_quantity, l_extendedprice FROM lineitem")
def q_points_all(spark, sf):
    return B.points(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                    max_points=None)


@register("ols", """
SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 10) AS r2 FROM lineitem""")
def q_ols(spark, sf):
    return rounded(T.ols(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"),
                   {"slope": 6, "intercept": 6, "r2": 10})


def _flat(fits):
    return fits.select("kind", "n", F.round(F.col("coefficients")[0], 6).alias("c0"),
                       F.round(F.col("coefficients")[1], 6).alias("c1"), "r2",
                       F.round("x_min", 6).alias("x_min"), F.round("x_max", 6).alias("x_max"))


LIN_SQL = """WITH d AS (SELECT o_totalprice AS x, o_totalprice * 0.9 + (o_orderkey % 1000) AS y FROM orders)
SELECT 'linear' AS kind, count(*) AS n, round(regr_slope(y, x), 6) AS c0,
       round(regr_intercept(y, x), 6) AS c1,
       round(1 - (regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x))
                 / greatest(regr_syy(y, x), 1e-10), 4) AS r2,
       round(min(x), 6) AS x_min, round(max(x), 6) AS x_max FROM d"""


def _orders_xy(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_totalprice").alias("x"),
                    (F.col("o_totalprice") * 0.9 + F.col("o_orderkey") % 1000).alias("y"))


@register("trend_linear", LIN_SQL)
def q_trend_linear(spark, sf):
    return _flat(T.trendline(_orders_xy(spark, sf), "x", "y", "linear"))


@register("trend_exponential", """
WITH d AS (SELECT o_totalprice AS x, o_totalprice * 0.9 + (o_orderkey % 1000) AS y FROM orders),
f AS (SELECT count(*) AS n, regr_slope(ln(y), x) AS b, exp(regr_intercept(ln(y), x)) AS a,
             avg(y) AS ybar, min(x) AS x_min, max(x) AS x_max FROM d),
s AS (SELECT sum((y - a * exp(b * x)) * (y - a * exp(b * x))) AS ssres,
             sum((y - ybar) * (y - ybar)) AS sstot FROM d, f)
SELECT 'exponential' AS kind, n, round(a, 6) AS c0, round(b, 6) AS c1,
       round(1 - ssres / greatest(sstot, 1e-10), 4) AS r2, round(x_min, 6) AS x_min,
       round(x_max, 6) AS x_max FROM f, s""")
def q_trend_exponential(spark, sf):
    return _flat(T.trendline(_orders_xy(spark, sf), "x", "y", "exponential"))


def _cubic_sql(last: str) -> str:
    """Least-squares cubic by orthogonal polynomials of the standardised x."""
    return f"""WITH d AS (SELECT o_totalprice AS x, o_totalprice * 0.9 + (o_orderkey % 1000) AS y FROM orders),
m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS yb, count(*) AS n, min(x) AS lo, max(x) AS hi FROM d),
q1 AS (SELECT (x - mx) / sx AS p1, y FROM d, m),
s1 AS (SELECT sum(p1 * p1 * p1) / sum(p1 * p1) AS a1, sum(p1 * p1) / count(*) AS b1 FROM q1),
q2 AS (SELECT p1, y, (p1 - a1) * p1 - b1 AS p2 FROM q1, s1),
s2 AS (SELECT sum(p1 * p2 * p2) / sum(p2 * p2) AS a2, sum(p2 * p2) / sum(p1 * p1) AS b2 FROM q2),
q3 AS (SELECT p1, p2, y, (p1 - a2) * p2 - b2 * p1 AS p3 FROM q2, s2),
c AS (SELECT sum(y * p1) / sum(p1 * p1) AS c1, sum(y * p2) / sum(p2 * p2) AS c2,
  sum(y * p3) / sum(p3 * p3) AS c3 FROM q3),
r AS (SELECT 1 - sum(pow(y - yb - c1 * p1 - c2 * p2 - c3 * p3, 2)) / sum(pow(y - yb, 2)) AS r2 FROM q3, c, m)
{last}"""


@register("trend_polynomial_curve", _cubic_sql("""
, g AS (SELECT lo + (hi - lo) * i / 299 AS x, (lo + (hi - lo) * i / 299 - mx) / sx AS p1
  FROM m, range(300) t(i))
SELECT 'polynomial' AS kind, round(x, 6) AS x,
  round(yb + c1 * p1 + c2 * ((p1 - a1) * p1 - b1)
        + c3 * ((p1 - a2) * ((p1 - a1) * p1 - b1) - b2 * p1), 2) AS y FROM g, c, m, s1, s2"""))
def q_trend_polynomial_curve(spark, sf):
    c = T.trend_curve(T.trendline(_orders_xy(spark, sf), "x", "y", "polynomial", degree=3))
    return rounded(c, {"x": 6, "y": 2})


@register("trend_polynomial")
def q_trend_polynomial(spark, sf):
    fit = T.trendline(_orders_xy(spark, sf), "x", "y", "polynomial", degree=3)
    return fit.select("kind", "n", F.array_join(F.transform("coefficients",
                                                            lambda c: F.format_number(c, 10)),
                                                ",").alias("coefficients"), "r2")


@register("trend_all", _cubic_sql("""
, e AS (SELECT exp(regr_intercept(ln(y), x)) AS a, regr_slope(ln(y), x) AS b FROM d),
er AS (SELECT 1 - sum(pow(y - a * exp(b * x), 2)) / sum(pow(y - yb, 2)) AS r2 FROM d, e, m)
SELECT 'linear' AS kind, n, round((SELECT regr_r2(y, x) FROM d), 4) AS r2 FROM m
UNION ALL SELECT 'polynomial', n, round(r2, 4) FROM m, r
UNION ALL SELECT 'exponential', n, round(r2, 4) FROM m, er"""))
def q_trend_all(spark, sf):
    fit = T.trendline(_orders_xy(spark, sf), "x", "y", "all")
    return fit.select("kind", "n", "r2")


@register("trend_curve", """WITH f AS (
  SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, min(x) AS lo, max(x) AS hi
  FROM (SELECT o_totalprice AS x, o_totalprice * 0.9 + (o_orderkey % 1000) AS y FROM orders)),
g AS (SELECT lo + (hi - lo) * i / 299 AS x, a, b FROM f, range(300) t(i))
SELECT 'linear' AS kind, round(x, 6) AS x, round(a * x + b, 4) AS y FROM g""")
def q_trend_curve(spark, sf):
    c = T.trend_curve(T.trendline(_orders_xy(spark, sf), "x", "y", "linear"))
    return rounded(c, {"x": 6, "y": 4})


@register("trend_time", """
WITH d AS (SELECT epoch(o_orderdate)::DOUBLE AS x, o_totalprice AS y FROM orders)
SELECT 'linear' AS kind, count(*) AS n, round(regr_slope(y, x), 10) AS c0,
       round(regr_intercept(y, x), 4) AS c1,
       round(1 - (regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x))
                 / greatest(regr_syy(y, x), 1e-10), 4) AS r2 FROM d""")
def q_trend_time(spark, sf):
    f = T.trend_over_time(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return f.select("kind", "n", F.round(F.col("coefficients")[0], 10).alias("c0"),
                    F.round(F.col("coefficients")[1], 4).alias("c1"), "r2")


@register("standardize", """
SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6)
    AS l_extendedprice FROM lineitem""")
def q_standardize(spark, sf):
    z = T.standardize(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                      keep=["l_orderkey", "l_linenumber"])
    return rounded(z, {"l_quantity": 6, "l_extendedprice": 6})


KM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@register("kmeans_sizes")
def q_kmeans_sizes(spark, sf):
    lab = T.kmeans(table(spark, sf, "lineitem"), KM_FEATURES, k=4)
    return T.cluster_sizes(lab)


@register("kmeans_means")
def q_kmeans_means(spark, sf):
    lab = T.kmeans(table(spark, sf, "lineitem"), KM_FEATURES, k=4)
    return T.cluster_means(lab, KM_FEATURES)


def _alert_sql(src_cte: str, src: str, cols: list[tuple[str, bool]]) -> str:
    """SQL of the alert rules for columns (name, numeric)."""
    parts = []
    pos = {c: i for i, (c, _) in enumerate(cols)}
    for c, numeric in cols:
        if numeric:
            parts.append(f"""SELECT {pos[c] * 10} AS o, CASE WHEN pct > 10 THEN 'critical' ELSE 'warning' END AS severity,
  '{c}' AS "column", 'Outliers (IQR)' AS issue,
  CAST(outl AS VARCHAR) || ' values (' || CAST(round(pct, 1) AS VARCHAR) || '%) outside IQR fence' AS detail,
  round(pct, 4) AS value FROM (
    SELECT n, outl, outl * 100.0 / n AS pct FROM (
      SELECT count(v) AS n, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outl,
             q1, q3 FROM (SELECT {c}::DOUBLE AS v FROM {src} WHERE {c} IS NOT NULL),
             (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}) GROUP BY q1, q3)
    WHERE n >= 4 AND q3 <> q1) WHERE outl > 0""")
            parts.append(f"""SELECT {pos[c] * 10 + 1} AS o, 'warning' AS severity, '{c}' AS "column",
  'High skewness' AS issue, 'skew = ' || CAST(round(sk, 2) AS VARCHAR) || ' — consider log transform' AS detail,
  round(sk, 4) AS value FROM (SELECT count({c}) AS n, skewness({c}) AS sk, quantile_cont({c}, 0.25) AS q1,
  quantile_cont({c}, 0.75) AS q3 FROM {src}) WHERE n >= 4 AND q3 <> q1 AND abs(sk) > 2""")
        base = 10 * (len(cols) + 1)
        parts.append(f"""SELECT {base + pos[c]} AS o, CASE WHEN pct > 30 THEN 'critical' ELSE 'warning' END AS severity,
  '{c}' AS "column", CASE WHEN pct > 30 THEN 'High missing %' ELSE 'Missing values' END AS issue,
  CAST(round(pct, 1) AS VARCHAR) || '% missing' AS detail, round(pct, 4) AS value
  FROM (SELECT (count(*) - count({c})) * 100.0 / count(*) AS pct FROM {src}) WHERE pct > 5""")
    parts.append(f"""SELECT {10 * (len(cols) + 1) + len(cols)} AS o, 'warning' AS severity, 'Dataset' AS "column",
  'Duplicates' AS issue, CAST(d AS VARCHAR) || ' duplicate rows' AS detail, d::DOUBLE AS value
  FROM (SELECT (SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS d)
  WHERE d > 0""")
    return f"WITH {src_cte}, al AS (" + " UNION ALL ".join(parts) + ")"


EV_ALERT_COLS = [("event_id", True), ("ts", False), ("user_id", True), ("event_type", False),
                 ("value", True), ("props", False)]
ALERTS_EV = _alert_sql(EVENTS_DIRTY.strip(), "evd", EV_ALERT_COLS)


@register("alerts", ALERTS_EV + ' SELECT severity, "column", issue, detail, value FROM al')
def q_alerts(spark, sf):
    return AL.alerts(events_dirty(spark, sf))


@register("alert_totals", ALERTS_EV + """ SELECT count(*) AS total,
  count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'warning') AS warnings FROM al""")
def q_alert_totals(spark, sf):
    return AL.alert_totals(AL.alerts(events_dirty(spark, sf)))


DOC_CTE = """dl AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d
                  LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id", "left") \
            .select("doc_id", "n_chars", "quality", "toxic")


@register("alerts_documents", _alert_sql(DOC_CTE, "dl", [("doc_id", True), ("n_chars", True),
                                                          ("quality", True), ("toxic", True)])
          + ' SELECT severity, "column", issue, detail, value FROM al')
def q_alerts_documents(spark, sf):
    return AL.alerts(_docs(spark, sf))


@register("recommend", f"""WITH {EVENTS_DIRTY},
m AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (count(*) - count({c})) * 100.0 / count(*) AS pct,
       (min({c}) IS NULL OR min({c}) = max({c})) AS constant,
       {"(SELECT count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) FROM (SELECT " + c + " AS v FROM evd WHERE " + c + " IS NOT NULL), (SELECT quantile_cont(" + c + ", 0.25) AS q1, quantile_cont(" + c + ", 0.75) AS q3 FROM evd) WHERE q3 <> q1)" if num else "0"} AS outl
       FROM evd""" for c, num in EV_ALERT_COLS) + """)
SELECT "column",
  CASE WHEN pct > 30 THEN 'drop' WHEN constant THEN 'drop' WHEN pct > 5 THEN 'impute'
       WHEN coalesce(outl, 0) > 0 THEN 'flag' ELSE 'keep' END AS action,
  CASE WHEN pct > 30 THEN 'high missing share' WHEN constant THEN 'constant column'
       WHEN pct > 5 THEN 'missing values' WHEN coalesce(outl, 0) > 0 THEN 'IQR outliers'
       ELSE 'no issue' END AS reason FROM m""")
def q_recommend(spark, sf):
    return AL.recommend(events_dirty(spark, sf))


@register("run_spec_bar", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS l_extendedprice
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_run_spec_bar(spark, sf):
    out = S.run_spec(table(spark, sf, "lineitem"),
                     {"chart_type": "Bar", "x_col": "l_returnflag", "y_col": "l_extendedprice",
                      "color_by": "l_linestatus", "aggregation": "mean"})
    return rounded(out, {"l_extendedprice": 6})


@register("run_spec_fallback", """
SELECT o_orderkey, count(*) AS count FROM orders GROUP BY o_orderkey""")
def q_run_spec_fallback(spark, sf):
    # unknown x and y columns: x falls back to the first column, y to none -> value counts
    return S.run_spec(table(spark, sf, "orders"),
                      {"chart_type": None, "x_col": "no such column", "y_col": "nope"})


@register("run_spec_pie", """
WITH vc AS (SELECT lang, count(*) AS count FROM documents GROUP BY lang
            ORDER BY count DESC, lang LIMIT 10)
SELECT lang, count, round(count / sum(count) OVER (), 6) AS share FROM vc""")
def q_run_spec_pie(spark, sf):
    return rounded(S.run_spec(table(spark, sf, "documents"),
                              {"chart_type": "Pie Chart", "x_col": "lang"}), {"share": 6})


@register("answer_top", """
SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice FROM orders
GROUP BY o_orderpriority ORDER BY sum(o_totalprice) DESC, o_orderpriority LIMIT 3""")
def q_answer_top(spark, sf):
    out = S.answer(table(spark, sf, "orders"), "bar", "o_orderpriority", "o_totalprice", "sum", 3)
    return rounded(out, {"o_totalprice": 2})


def _digest_sql() -> str:
    from quarry.plans.q_profile import EV_NUM, _describe_sql, _profile_sql
    prof = _profile_sql()[len(f"WITH {EVENTS_DIRTY} "):]
    return (f"WITH {EVENTS_DIRTY}, pr AS ({prof}), ds AS ({_describe_sql('evd', EV_NUM)}) "
            'SELECT * FROM pr LEFT JOIN ds USING ("column")')


@register("digest", _digest_sql())
def q_digest(spark, sf):
    return S.digest_table(events_dirty(spark, sf))


def _scratch(spark, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-io/{kind}-{uuid.uuid4().hex}"


@register("csv_roundtrip", "SELECT * FROM part")
def q_csv_roundtrip(spark, sf):
    path = _scratch(spark, "csv")
    IO.write_csv(table(spark, sf, "part"), path)
    return IO.read_csv(spark, path)


@register("csv_uri_roundtrip", "SELECT * FROM nation")
def q_csv_uri_roundtrip(spark, sf):
    path = _scratch(spark, "csv")
    IO.write_csv(table(spark, sf, "nation"), path)
    uri = path if "://" in path or path.startswith("file:") else "file://" + path
    return IO.read_csv(spark, uri)


@register("json_roundtrip", "SELECT * FROM customer")
def q_json_roundtrip(spark, sf):
    path = _scratch(spark, "json")
    IO.write_json(table(spark, sf, "customer"), path)
    return IO.read_json(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                            "c_mktsegment")


@register("report_quality", """SELECT * FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round((count(*) - count({c})) * 100.0 / count(*), 1) AS missing_pct,
        count(DISTINCT {c}) AS "unique" FROM part"""
    for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]) + ")")
def q_report_quality(spark, sf):
    path = _scratch(spark, "report")
    out = IO.write_report(table(spark, sf, "part"), path)
    return spark.read.parquet(out["quality"])


@register("kmeans_labels")
def q_kmeans_labels(spark, sf):
    return T.kmeans(table(spark, sf, "lineitem"), KM_FEATURES, k=4) \
        .select("l_orderkey", "l_linenumber", *KM_FEATURES, "Cluster")


@register("report_statistics", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 3) AS mean,
       round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min,
       round(quantile_cont({c}, 0.25), 3) AS p25, round(quantile_cont({c}, 0.5), 3) AS p50,
       round(quantile_cont({c}, 0.75), 3) AS p75, round(max({c}), 3) AS max FROM part"""
    for c in ("p_partkey", "p_size", "p_retailprice")))
def q_report_statistics(spark, sf):
    path = _scratch(spark, "report")
    out = IO.write_report(table(spark, sf, "part"), path)
    return spark.read.parquet(out["statistics"])
