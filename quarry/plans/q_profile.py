"""Registered queries: describe, profile, missing cells, duplicates, quality, moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.plans.catalog import EVENTS_DIRTY, events_dirty, register, rounded, table


def _describe_sql(src: str, cols: list[str], with_cte: str = "") -> str:
    parts = [f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 2) AS mean,
       round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min,
       round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
       round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM {src}"""
             for c in cols]
    return with_cte + " UNION ALL ".join(parts)


EV_NUM = ["event_id", "user_id", "value"]


@register("describe", _describe_sql("evd", EV_NUM, f"WITH {EVENTS_DIRTY} "))
def q_describe(spark, sf):
    return P.describe(events_dirty(spark, sf))


@register("describe_pair", _describe_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def q_describe_pair(spark, sf):
    return P.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _dist_sql() -> str:
    parts = [f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max,
       round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM lineitem"""
             for c in LI_NUM]
    return " UNION ALL ".join(parts)


@register("distribution", _dist_sql())
def q_distribution(spark, sf):
    return P.distribution(table(spark, sf, "lineitem"), LI_NUM)


EV_COLS = [("event_id", "bigint", "numerical"), ("ts", "timestamp_ntz", "datetime"),
           ("user_id", "bigint", "numerical"), ("event_type", "string", None),
           ("value", "double", "numerical"), ("props", "string", None)]


def _profile_sql() -> str:
    parts = []
    for c, dt, kind in EV_COLS:
        k = (f"'{kind}'" if kind else
             f"CASE WHEN avg(len(regexp_extract_all({c}, '\\S+'))) > 4 THEN 'text' "
             f"ELSE 'categorical' END")
        parts.append(f"""SELECT '{c}' AS column, '{dt}' AS dtype, {k} AS kind,
            count({c}) AS non_null,
            round((count(*) - count({c})) * 100.0 / count(*), 1) AS missing_pct,
            count(DISTINCT {c}) AS "unique" FROM evd""")
    return f"WITH {EVENTS_DIRTY} " + " UNION ALL ".join(parts)


@register("profile", _profile_sql())
def q_profile(spark, sf):
    return P.profile(events_dirty(spark, sf))


@register("quality_table", f"""SELECT "column", missing_pct, "unique" FROM ({_profile_sql()})""")
def q_quality_table(spark, sf):
    return P.quality_table(events_dirty(spark, sf))


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, count(*) AS rows FROM evd"
             for c, _, _ in EV_COLS]
    return f"WITH {EVENTS_DIRTY}, m AS (" + " UNION ALL ".join(parts) + ")"


@register("missing_report", _missing_sql() + """
SELECT "column", missing, round(missing * 100.0 / rows, 1) AS missing_pct FROM m
WHERE missing > 0""")
def q_missing_report(spark, sf):
    return P.missing_report(events_dirty(spark, sf))


@register("missing_total", _missing_sql() + " SELECT sum(missing) AS missing_total FROM m")
def q_missing_total(spark, sf):
    return P.missing_total(events_dirty(spark, sf))


DUPS_SQL = ("dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM evd)) "
            "AS duplicates FROM evd)")


@register("duplicate_count", f"WITH {EVENTS_DIRTY}, {DUPS_SQL} SELECT duplicates FROM dup")
def q_duplicate_count(spark, sf):
    return P.duplicate_count(events_dirty(spark, sf))


QUALITY_SQL = _missing_sql() + f""", {DUPS_SQL},
q AS (SELECT (SELECT count(*) FROM evd) AS rows, 6 AS columns,
             (SELECT sum(missing) FROM m) AS missing_cells, (SELECT duplicates FROM dup) AS duplicates)
SELECT rows, columns, missing_cells, duplicates,
       round(least(100.0, greatest(0.0, 100.0 - missing_cells / (rows * 6.0) * 50
                                          - duplicates / rows::DOUBLE * 30)), 1) AS quality
FROM q"""


@register("quality_score", QUALITY_SQL)
def q_quality_score(spark, sf):
    return P.quality_score(events_dirty(spark, sf))


@register("meta", f"""SELECT rows, columns, quality,
  'event_id,ts,user_id,event_type,value,props' AS column_names FROM ({QUALITY_SQL})""")
def q_meta(spark, sf):
    m = P.meta(events_dirty(spark, sf))
    return m.withColumn("column_names", F.array_join("column_names", ","))


@register("constant_columns", f"""WITH {EVENTS_DIRTY}, e1 AS (SELECT *, 1 AS one FROM evd)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, (min({c}) IS NULL OR min({c}) = max({c})) AS constant FROM e1"
    for c in [c for c, _, _ in EV_COLS] + ["one"]))
def q_constant_columns(spark, sf):
    return P.constant_columns(events_dirty(spark, sf).withColumn("one", F.lit(1)))


@register("central", f"""WITH {EVENTS_DIRTY},
mo AS (SELECT value FROM evd WHERE value IS NOT NULL GROUP BY value
       ORDER BY count(*) DESC, value LIMIT 1)
SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
       (SELECT value FROM mo) AS mode FROM evd""")
def q_central(spark, sf):
    return rounded(P.central(events_dirty(spark, sf), "value"), {"mean": 6, "median": 6})


@register("preview", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY orders.o_orderkey LIMIT 10""")
def q_preview(spark, sf):
    return P.preview(table(spark, sf, "orders"), 10, ["o_orderkey"])


@register("preview_tail", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY orders.o_orderkey DESC LIMIT 10""")
def q_preview_tail(spark, sf):
    return P.preview(table(spark, sf, "orders"), 10, ["o_orderkey"], mode="tail")


@register("preview_random", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY md5(concat_ws('|', '7', orders.o_orderkey, orders.o_custkey, orders.o_orderstatus,
  orders.o_totalprice, orders.o_orderdate, orders.o_orderpriority)) LIMIT 20""")
def q_preview_random(spark, sf):
    return P.preview(table(spark, sf, "orders"), 20, mode="random", seed=7)


def _kinds_sql(tbl: str, cols: list[tuple[str, str, str | None]]) -> str:
    parts = []
    for c, dt, kind in cols:
        w = f"avg(len(regexp_extract_all({c}, '\\S+')))"
        k = f"'{kind}'" if kind else f"CASE WHEN {w} > 4 THEN 'text' ELSE 'categorical' END"
        aw = "CAST(NULL AS DOUBLE)" if kind else f"round({w}, 6)"
        src = f"(SELECT 1 FROM {tbl} LIMIT 1)" if kind else tbl
        parts.append(f"SELECT '{c}' AS \"column\", '{dt}' AS dtype, {k} AS kind, {aw} AS avg_words "
                     f"FROM {src}")
    return " UNION ALL ".join(parts)


DOC_KINDS = [("doc_id", "bigint", "numerical"), ("text", "string", None),
             ("lang", "string", None), ("source", "string", None),
             ("n_chars", "bigint", "numerical")]


@register("column_kinds", _kinds_sql("documents", DOC_KINDS))
def q_column_kinds(spark, sf):
    from quarry.functions.kinds import column_kinds
    return rounded(column_kinds(table(spark, sf, "documents")), {"avg_words": 6})


@register("column_kinds_mixed", _kinds_sql("embeddings", [
    ("vec_id", "bigint", "numerical"), ("embedding", "array<float>", "unknown"),
    ("label", "int", "numerical")]))
def q_column_kinds_mixed(spark, sf):
    from quarry.functions.kinds import column_kinds
    return column_kinds(table(spark, sf, "embeddings"))


@register("quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p} AS p, round(quantile_cont({c}, {p}), 6) AS q FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount")
    for p in (0.0, 0.01, 0.1, 0.333, 0.5, 0.9, 0.99, 1.0)))
def q_quantiles(spark, sf):
    from quarry.functions.quantiles import quantiles
    q = quantiles(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                  [0.0, 0.01, 0.1, 0.333, 0.5, 0.9, 0.99, 1.0])
    return rounded(q, {"q": 6})


@register("quantiles_by", " UNION ALL ".join(
    f"SELECT o_orderpriority, 'o_totalprice' AS \"column\", {p} AS p, "
    f"round(quantile_cont(o_totalprice, {p}), 6) AS q FROM orders GROUP BY o_orderpriority"
    for p in (0.05, 0.5, 0.95)))
def q_quantiles_by(spark, sf):
    from quarry.functions.quantiles import quantiles
    q = quantiles(table(spark, sf, "orders"), ["o_totalprice"], [0.05, 0.5, 0.95],
                  by=["o_orderpriority"])
    return rounded(q, {"q": 6})


@register("moments", f"""WITH {EVENTS_DIRTY} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 6) AS skew, "
    f"round(kurtosis({c}), 6) AS kurtosis FROM evd" for c in EV_NUM))
def q_moments(spark, sf):
    return rounded(P.moments(events_dirty(spark, sf)), {"skew": 6, "kurtosis": 6})
