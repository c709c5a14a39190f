"""Registered queries: grouped aggregates, counts, top-N, periods, cross-tabs, words, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.plans.catalog import EVENTS_DIRTY, register, rounded, table, events_dirty


@register("group_agg_sum", """
SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_extendedprice), 0), 2) AS revenue
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_agg_sum(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.group_agg(li, "l_returnflag", "l_extendedprice", "sum",
                               color="l_linestatus", alias="revenue"), {"revenue": 2})


@register("group_agg_mean", f"""
WITH {EVENTS_DIRTY}
SELECT event_type, round(avg(value), 6) AS value FROM evd
WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_group_agg_mean(spark, sf):
    return rounded(A.group_agg(events_dirty(spark, sf), "event_type", "value", "mean"),
                   {"value": 6})


@register("group_agg_count", f"""
WITH {EVENTS_DIRTY}
SELECT event_type, count(value) AS value FROM evd
WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_group_agg_count(spark, sf):
    return A.group_agg(events_dirty(spark, sf), "event_type", "value", "count")


@register("group_agg_min", """
SELECT l_returnflag, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_returnflag""")
def q_group_agg_min(spark, sf):
    return A.group_agg(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "min")


@register("group_agg_max", """
SELECT o_orderpriority, o_orderstatus, max(o_totalprice) AS o_totalprice FROM orders
GROUP BY o_orderpriority, o_orderstatus""")
def q_group_agg_max(spark, sf):
    return A.group_agg(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "max",
                       color="o_orderstatus")


@register("group_agg_median", """
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_price
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_agg_median(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.group_agg(li, "l_returnflag", "l_extendedprice", "median",
                               color="l_linestatus", alias="median_price"),
                   {"median_price": 6})


@register("value_counts", """
SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority""")
def q_value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@register("value_counts_top", """
SELECT p_name, count(*) AS count FROM part GROUP BY p_name
ORDER BY count DESC, p_name LIMIT 12""")
def q_value_counts_top(spark, sf):
    return A.value_counts(table(spark, sf, "part"), "p_name", top_n=12)


@register("shares", """
WITH vc AS (SELECT p_type, count(*) AS count FROM part GROUP BY p_type
            ORDER BY count DESC, p_type LIMIT 4)
SELECT p_type, count, round(count / sum(count) OVER (), 6) AS share FROM vc""")
def q_shares(spark, sf):
    return rounded(A.shares(table(spark, sf, "part"), "p_type", top_n=4), {"share": 6})


@register("top_n", """
SELECT l_suppkey, round(coalesce(sum(l_extendedprice), 0), 2) AS revenue FROM lineitem
GROUP BY l_suppkey ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 10""")
def q_top_n(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.top_n(li, "l_suppkey", "l_extendedprice", "sum", 10, alias="revenue"),
                   {"revenue": 2})


@register("line", """
SELECT o_orderdate, o_orderstatus, round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice
FROM orders GROUP BY o_orderdate, o_orderstatus""")
def q_line(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(A.line(o, "o_orderdate", "o_totalprice", "o_orderstatus", agg="sum"),
                   {"o_totalprice": 2})


@register("by_period_day", """
SELECT date_trunc('day', ts) AS period, count(*) AS count FROM events GROUP BY 1""")
def q_by_period_day(spark, sf):
    return A.by_period(table(spark, sf, "events"), "ts", "day")


@register("by_period_month", """
SELECT date_trunc('month', o_orderdate) AS period, round(avg(o_totalprice), 6) AS avg_price
FROM orders GROUP BY 1""")
def q_by_period_month(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(A.by_period(o, "o_orderdate", "month", "o_totalprice", "mean",
                               alias="avg_price"), {"avg_price": 6})


@register("crosstab", """
SELECT o_orderstatus,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
       count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH",
       count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
       count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
       count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW"
FROM orders GROUP BY o_orderstatus""")
def q_crosstab(spark, sf):
    return A.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


WORDS_SQL = """
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word
           FROM documents)
SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY word"""


@register("word_counts", WORDS_SQL)
def q_word_counts(spark, sf):
    return A.word_counts(table(spark, sf, "documents"), "text")


@register("word_counts_top", WORDS_SQL + " ORDER BY count DESC, word LIMIT 50")
def q_word_counts_top(spark, sf):
    return A.word_counts(table(spark, sf, "documents"), "text", top_n=50)


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "one"]


def _corr_sql(pairs_only: bool) -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            if pairs_only and not i < j:
                continue
            x = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            y = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({x}, {y}) / "
                f"nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6) AS r FROM li")
    return ("WITH li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, 1.0 AS one "
            "FROM lineitem) " + " UNION ALL ".join(parts))


def _li_corr(spark, sf):
    return table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))


@register("correlation", _corr_sql(False))
def q_correlation(spark, sf):
    return rounded(A.correlation(_li_corr(spark, sf), CORR_COLS), {"r": 6})


@register("correlation_pairs", _corr_sql(True))
def q_correlation_pairs(spark, sf):
    return rounded(A.correlation_pairs(_li_corr(spark, sf), CORR_COLS), {"r": 6})


def _corr_matrix_sql() -> str:
    cells = ", ".join(f"max(r) FILTER (WHERE b = '{c}') AS {c}" for c in CORR_COLS)
    return f"SELECT a AS \"column\", {cells} FROM ({_corr_sql(False)}) GROUP BY a"


@register("correlation_matrix", _corr_matrix_sql())
def q_correlation_matrix(spark, sf):
    m = A.correlation_matrix(_li_corr(spark, sf), CORR_COLS)
    return rounded(m, {c: 6 for c in CORR_COLS})
