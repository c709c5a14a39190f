"""Registered queries: pivot tables with margins (lineitem with derived missing values)."""

from __future__ import annotations

from quarry.operators.pivot import pivot
from quarry.plans.catalog import LINEITEM_DIRTY, lineitem_dirty, register

SQL_AGG = {"sum": "coalesce(sum({v}), 0)", "mean": "avg({v})", "count": "count({v})",
           "min": "min({v})", "max": "max({v})", "median": "quantile_cont({v}, 0.5)"}


def pivot_sql(r: str, c: str | None, cvals: list[str], vals: list[str], agg: str,
              as_text: bool = False) -> str:
    a = lambda v: SQL_AGG[agg].format(v=v)
    cells = (lambda e: f"coalesce(CAST(round({e}, 2) AS VARCHAR), '')") if as_text \
        else (lambda e: f"round({e}, 2)")
    present = " AND ".join(f"{x} IS NOT NULL" for x in vals)
    ccond = f" AND {c} IS NOT NULL" if c else ""
    aggs = ", ".join(f"{a(v)} AS {v}" for v in vals)
    sql = f"""WITH {LINEITEM_DIRTY},
base AS (SELECT * FROM lid WHERE {r} IS NOT NULL{ccond}),
comp AS (SELECT * FROM base WHERE {present}),
ctot AS (SELECT {r}, {aggs} FROM comp GROUP BY {r}),
gtot AS (SELECT {aggs} FROM comp)"""
    if c:
        sql += f""",
body AS (SELECT {r}, {c}, {aggs} FROM base GROUP BY {r}, {c}),
rtot AS (SELECT {c}, {aggs} FROM comp GROUP BY {c})"""
    multi = len(vals) > 1
    nm = (lambda v, cv: f'"{v}_{cv}"') if multi else (lambda v, cv: f'"{cv}"')
    top, bottom = [], []
    for v in vals:
        if c:
            for cv in cvals:
                top.append(f"{cells(f'(SELECT b.{v} FROM body b WHERE b.{r} = k.{r} AND b.{c} = {cv!r})')} AS {nm(v, cv)}")
                bottom.append(f"{cells(f'(SELECT t.{v} FROM rtot t WHERE t.{c} = {cv!r})')}")
            top.append(f"{cells(f'(SELECT t.{v} FROM ctot t WHERE t.{r} = k.{r})')} AS {nm(v, 'Total')}")
            bottom.append(f"{cells(f'(SELECT g.{v} FROM gtot g)')}")
        else:
            top.append(f"{cells(f'(SELECT t.{v} FROM ctot t WHERE t.{r} = k.{r})')} AS \"{v}\"")
            bottom.append(f"{cells(f'(SELECT g.{v} FROM gtot g)')}")
    if not c:
        # body = per-key aggregate over base (not comp)
        sql = sql.replace(f"ctot AS (SELECT {r}, {aggs} FROM comp GROUP BY {r})",
                          f"ctot AS (SELECT {r}, {aggs} FROM base GROUP BY {r})")
    sql += f"""
SELECT CAST(k.{r} AS VARCHAR) AS {r}, {", ".join(top)} FROM (SELECT DISTINCT {r} FROM base) k
UNION ALL SELECT 'Total', {", ".join(bottom)}"""
    return sql


LS = ["F", "O"]


def _reg(name, cols, vals, agg, as_text=False):
    c = cols[0] if cols else None

    def fn(spark, sf):
        return pivot(lineitem_dirty(spark, sf), ["l_returnflag"], cols, vals, agg,
                     as_text=as_text)
    register(name, pivot_sql("l_returnflag", c, LS, vals, agg, as_text))(fn)


for _agg in ("sum", "mean", "count", "min", "max", "median"):
    _reg(f"pivot_{_agg}", ["l_linestatus"], ["l_discount"], _agg)
_reg("pivot_two_values", ["l_linestatus"], ["l_discount", "l_quantity"], "sum")
_reg("pivot_no_columns", [], ["l_discount"], "mean")
_reg("pivot_as_text", ["l_linestatus"], ["l_discount"], "max", as_text=True)
