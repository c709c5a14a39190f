"""Execution of chart specs and resolved questions: the data behind each chart kind.

A spec names a chart kind and columns; ``run_spec`` dispatches to the operator that computes
that chart's data and returns one DataFrame. Unknown columns become "none", a missing x the
first column, a missing chart kind "bar", a missing aggregation "sum" (the fall-backs of the
spec form). Question wording is not parsed here: callers pass the resolved fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import col, numeric_columns
from quarry.operators import aggregate as A
from quarry.operators import bins as B
from quarry.operators import fit as T
from quarry.operators import profile as P
from quarry.operators import windows as W

# Chart kinds and their aliases as the two front ends name them.
CHARTS = {
    "bar": "bar", "bar chart": "bar", "horizontal bar": "bar", "bar (aggregated)": "bar",
    "grouped bar": "bar", "stacked bar": "bar", "bar chart (top n)": "top",
    "line": "line", "line chart": "line", "line plot": "line",
    "area": "area", "area chart": "area",
    "pie": "pie", "pie chart": "pie", "treemap": "pie",
    "scatter": "scatter", "scatter plot": "scatter", "strip plot": "points",
    "pair plot": "pair", "parallel coordinates": "parallel", "3d scatter": "scatter3d",
    "histogram": "histogram", "density plot": "density",
    "box": "box", "box plot": "box", "violin plot": "violin",
    "hexbin": "hist2d", "2d density": "hist2d",
    "heatmap": "corr", "correlation heatmap": "corr", "heatmap (counts)": "crosstab",
}


# Slices of a pie of counts when no number is asked for.
PIE_SLICES = {"pie": 10, "pie chart": 12}


@dataclass
class ChartSpec:
    chart_type: str | None = None
    x_col: str | None = None
    y_col: str | None = None
    color_by: str | None = None
    aggregation: str | None = None
    top_n: int | None = None


def resolve(df: DataFrame, spec: ChartSpec | dict) -> ChartSpec:
    """Apply the fall-backs: unknown column -> None, no x -> first column, no chart -> bar,
    no aggregation -> sum."""
    s = spec if isinstance(spec, ChartSpec) else ChartSpec(**{k: spec.get(k) for k in
                                                             ChartSpec.__dataclass_fields__})
    names = set(df.columns)
    fix = lambda c: c if c in names else None
    x = fix(s.x_col) or (df.columns[0] if df.columns else None)
    return ChartSpec((s.chart_type or "bar"), x, fix(s.y_col), fix(s.color_by),
                     s.aggregation or "sum", s.top_n)


def run_spec(df: DataFrame, spec: ChartSpec | dict, max_points: int | None = None) -> DataFrame:
    """The data of one chart."""
    s = resolve(df, spec)
    kind = CHARTS.get(s.chart_type.lower())
    if kind is None:
        raise ValueError(f"unknown chart type {s.chart_type!r}")
    x, y, c, agg, n = s.x_col, s.y_col, s.color_by, s.aggregation, s.top_n
    if kind == "bar":
        if y is None:
            return A.value_counts(df, x, n)
        if n:
            return A.top_n(df, x, y, agg, n)
        return A.group_agg(df, x, y, agg, c).orderBy(F.desc(y), *[col(k) for k in [x]])
    if kind == "top":
        return A.value_counts(df, x, n or 20)
    if kind == "line":
        if y is None:
            raise ValueError("a line chart needs y_col")
        # every row; only a top-N is aggregated
        return A.top_n(df, x, y, agg, n).orderBy(col(x)) if n else A.line(df, x, y, c)
    if kind == "area":
        if y is None:
            raise ValueError("an area chart needs y_col")
        if n:
            return A.top_n(df, x, y, agg, n).orderBy(col(x))
        return W.area_rows(df, x, y, c) if c else A.line(df, x, y)
    if kind == "pie":
        if y is not None:
            g = A.group_agg(df, x, y, agg).orderBy(F.desc(y), col(x))
            return g.limit(n) if n else g
        return A.shares(df, x, n or PIE_SLICES.get(s.chart_type.lower()))
    if kind == "scatter":
        if y is None:
            raise ValueError("a scatter chart needs y_col")
        if c:
            return B.points(df, [x, y], c, max_points)
        # every point with the fitted line's value at its x
        line = F.broadcast(T.ols(df, x, y).select("slope", "intercept"))      # one row
        fit = F.col("slope") * F.col("_p.x") + F.col("intercept")
        return B.points(df, [x, y], None, max_points).select(
            F.struct(col(x).alias("x"), col(y).alias("y")).alias("_p")).crossJoin(line) \
            .select(F.col("_p.x").alias(x), F.col("_p.y").alias(y), fit.alias("fit"))
    if kind == "points":
        return B.points(df, [y or x], c, max_points)
    if kind in ("pair", "parallel", "scatter3d"):
        k = {"pair": 5, "parallel": 8, "scatter3d": 3}[kind]
        return B.points(df, numeric_columns(df)[:k], c, max_points)
    if kind == "histogram":
        return B.histogram(df, x, 30, c)
    if kind == "density":
        return B.density(df, x, 40, c)
    if kind == "box":
        return B.box_stats(df, y or x, c)
    if kind == "violin":
        return B.violin(df, y or x, c, box=True)
    if kind == "hist2d":
        if y is None:
            raise ValueError("this chart needs y_col")
        return B.hist2d(df, x, y, 20, 20, c)
    if kind == "corr":
        return A.correlation_matrix(df)
    if kind == "crosstab":
        if y is None:
            raise ValueError("this chart needs y_col")
        return A.crosstab(df, x, y)
    raise ValueError(kind)


def answer(df: DataFrame, chart: str, x: str, y: str | None = None, agg: str = "sum",
           top_n: int | None = None) -> DataFrame:
    """Data of a resolved question: aggregate y per x (sorted by value, top-N if asked);
    a scatter gives the describe table of both columns; a histogram the 30 bins."""
    if chart == "scatter":
        return P.describe(df, [c for c in (x, y) if c])
    if chart == "histogram":
        return B.histogram(df, x, 30)
    if y is None:
        return A.value_counts(df, x, top_n)
    g = A.group_agg(df, x, y, agg).orderBy(F.desc(y), col(x))
    return g.limit(top_n) if top_n else g


def digest(df: DataFrame, sample_rows: int = 5, order_by=None) -> dict[str, DataFrame]:
    """Dataset digest: column profile, describe table and a few sample rows."""
    return {"profile": P.profile(df), "describe": P.describe(df),
            "sample": P.preview(df, sample_rows, order_by)}


def digest_table(df: DataFrame) -> DataFrame:
    """Profile and describe in one table (one row per column; describe cells for numbers)."""
    return P.profile(df).join(P.describe(df), "column", "left")
