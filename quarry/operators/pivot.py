"""Pivot tables with "Total" margins, built in long form and pivoted once.

Rules (those of a pandas ``pivot_table(..., margins=True, observed=True)`` call):

1. body cells: rows whose row or column key is missing are dropped; an all-missing group sums
   (and counts) to 0, its mean/min/max/median stay empty; a key pair with no row is empty;
2. margins use only rows complete in every row key, column key and value column, so a margin
   can be smaller than the sum of its body cells, or empty;
3. margins are recomputed from those rows (a median of rows, never of cells);
4. one grand "Total" row (first row key "Total", the others ""), no subtotals;
5. without column keys only the Total row is added, with them a Total column per value too;
6. rows whose cells are all empty are dropped; cells are rounded (2 places by default).

Body and margins are aggregated on the raw rows (partial + final hash aggregate, the margins in
one grouping-sets aggregate, medians of all levels in one quantile run). ``pivot_long`` returns
that table as it is, whatever the number of column keys; ``pivot`` spreads the column keys over
columns, for at most ``spark.sql.pivotMaxValues`` of them (Spark's own bound; more raise).

Column keys are matched by a code of their typed values, and named afterwards: the key values
joined with "_". A name that is taken already gets a number, so ("a_b", "c") and ("a", "b_c"),
or a key "Total", stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import cell_text, check_columns, col, nan_as_missing
from quarry.functions.quantiles import quantiles_long
from quarry.operators.aggregate import AGGREGATIONS, agg_expr, pivot_keys

TOTAL = "Total"
TOTAL_CODE = "T"


def _present(cols: Sequence[str]):
    cond = F.lit(True)
    for c in cols:
        cond = cond & col(c).isNotNull()
    return cond


def key_code(cols: Sequence[Column], types: Sequence[T.DataType]) -> Column:
    """Text that differs for different key tuples: each value's text after its length."""
    parts = []
    for c, t in zip(cols, types):
        x = F.hex(c) if isinstance(t, T.BinaryType) else \
            F.unix_micros(c) if isinstance(t, T.TimestampType) else \
            c + F.lit(0).cast(t) if isinstance(t, (T.DoubleType, T.FloatType)) else c
        x = x.cast("string")
        parts += [F.length(x).cast("string"), F.lit(":"), x]
    return F.concat(*parts)


def given_keys(spark: SparkSession, values: Sequence, types: Sequence[T.DataType]) -> list[tuple[str, tuple]]:
    """(code, labels) of column keys named by the caller (tuples for several keys), in one job."""
    schema = T.StructType([T.StructField("at", T.IntegerType()), *[T.StructField(f"k{i}", t) for i, t in enumerate(types)]])
    given = [tuple(k) if isinstance(k, (tuple, list)) else (k,) for k in values]
    code = key_code([F.col(f"k{i}") for i in range(len(types))], types)
    rows = spark.createDataFrame([(at, *k) for at, k in enumerate(given)], schema).select("at", code.alias("code"))
    codes = {r["at"]: r["code"] for r in rows.collect()}
    return [(codes[at], k) for at, k in enumerate(given)]


def _medians(base: DataFrame, rk: list[str], cks: list[str], vals: list[str],
             levels: dict[int, tuple[list[str], bool]]) -> DataFrame:
    """``_lvl`` + keys (NULL where rolled up) + one median per value, all levels in one run.

    Each row enters once for every level and value; the quantile core combines them map-side."""
    keys = rk + cks
    entries = []
    complete = _present(vals)
    for lvl, (kept, body) in levels.items():
        for i, v in enumerate(vals):
            entries.append(F.struct(
                F.struct(F.lit(lvl).alias("lvl"), F.lit(i).alias("i"),
                         *[(F.col(k) if k in kept else F.lit(None).cast(base.schema[k].dataType))
                           .alias(k) for k in keys]).alias("_key"),
                (F.col(v) if body else F.when(complete, F.col(v))).cast("double").alias("_mv")))
    q = quantiles_long(base.select(F.inline(F.array(*entries))), ["_key"], "_mv", [0.5])
    return (q.groupBy(F.col("_key.lvl").alias("_lvl"), *[F.col(f"_key.{k}").alias(k) for k in keys])
            .agg(*[F.max(F.when(F.col("_key.i") == i, F.col("q"))).alias(v)
                   for i, v in enumerate(vals)]))


def _long(df: DataFrame, rows: list[str], columns: list[str], values: list[str], agg: str,
          margins: bool) -> tuple[DataFrame, list[str], list[str], list[str], list[str]]:
    """Body and margins in long form: ``_lvl`` (0 rows, 1 Total row), row labels ``_r*``, typed
    row keys ``_s*``, column code ``_ck``, column keys ``_c*`` and the values ``_v*``."""
    if not rows or not values:
        raise ValueError("pivot needs at least one row key and one value column")
    check_columns(df, rows + columns + values)
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}; expected one of {AGGREGATIONS}")
    rk, sk = [f"_r{i}" for i in range(len(rows))], [f"_s{i}" for i in range(len(rows))]
    cks, vs = [f"_c{i}" for i in range(len(columns))], [f"_v{i}" for i in range(len(values))]
    base = df.where(_present(rows + columns)).select(
        *[col(c).alias(k) for c, k in zip(rows, rk)], *[col(c).alias(k) for c, k in zip(columns, cks)],
        *[col(c).alias(k) for c, k in zip(values, vs)])
    rtypes, ctypes = [base.schema[k].dataType for k in rk], [base.schema[k].dataType for k in cks]
    # levels: 0 body, 1 total over columns, 2 total over rows, 3 grand total
    if agg == "median":
        levels = {0: (rk + cks, True)}
        if margins and columns:
            levels |= {1: (rk, False), 2: (cks, False)}
        if margins:
            levels |= {3: ([], False)}
        out = _medians(base, rk, cks, vs, levels)
    else:
        aggs = [agg_expr(v, agg).alias(v) for v in vs]
        out = base.groupBy(*rk, *cks).agg(*aggs).withColumn("_lvl", F.lit(0))
        if margins:
            sets = [rk, cks, []] if columns else [[]]
            gs = (base.where(_present(vs))
                  .groupingSets([[F.col(c) for c in s] for s in sets], *rk, *cks)
                  .agg(F.grouping_id().alias("_gid"), *aggs))
            only_rows, only_cols = (1 << len(cks)) - 1, ((1 << len(rk)) - 1) << len(cks)
            lvl = F.when(F.col("_gid") == only_rows | only_cols, F.lit(3))
            if columns:
                lvl = lvl.when(F.col("_gid") == only_rows, F.lit(1)).otherwise(F.lit(2))
            out = out.unionByName(gs.withColumn("_lvl", lvl).drop("_gid"))
    total_row, total_col = F.col("_lvl") >= 2, F.col("_lvl").isin(1, 3)
    code = F.when(total_col, F.lit(TOTAL_CODE)).otherwise(
        key_code([F.col(k) for k in cks], ctypes)) if columns else F.lit(TOTAL_CODE)
    out = out.select(
        F.when(total_row, F.lit(1)).otherwise(F.lit(0)).alias("_lvl"),
        *[F.when(total_row, F.lit(TOTAL if i == 0 else "")).otherwise(F.col(k).cast("string")).alias(k)
          for i, k in enumerate(rk)],
        # typed copies of the keys keep the native sort order of the rows
        *[F.when(~total_row, F.col(k)).alias(s_) for k, s_ in zip(rk, sk)],
        code.alias("_ck"), *[F.when(~total_col, F.col(k)).alias(k) for k in cks], *vs)
    return out, rk, sk, cks, vs


@nan_as_missing
def pivot_long(df: DataFrame, rows: Sequence[str], columns: Sequence[str] = (),
               values: Sequence[str] = (), agg: str = "sum", margins: bool = True,
               round_to: int | None = 2) -> DataFrame:
    """The cells of a pivot, one row each: row keys and column keys as text ("Total" and "" in
    margins), then the values. Empty cells have no row. Any number of keys."""
    rows, columns, values = list(rows), list(columns), list(values)
    out, rk, sk, cks, vs = _long(df, rows, columns, values, agg, margins)
    r = (lambda c: F.round(c, round_to)) if round_to is not None else (lambda c: c)
    total = F.col("_ck") == TOTAL_CODE
    any_cell = F.coalesce(*[F.col(v).cast("string") for v in vs]).isNotNull()
    return out.where(any_cell).select(
        *[F.col(k).alias(c) for k, c in zip(rk, rows)],
        *[F.when(total, F.lit(TOTAL if i == 0 else "")).otherwise(F.col(k).cast("string")).alias(c)
          for i, (k, c) in enumerate(zip(cks, columns))],
        *[r(F.col(v)).alias(c) for v, c in zip(vs, values)])


@nan_as_missing
def pivot(df: DataFrame, rows: Sequence[str], columns: Sequence[str] = (),
          values: Sequence[str] = (), agg: str = "sum", margins: bool = True,
          round_to: int | None = 2, as_text: bool = False,
          column_values: Sequence | None = None) -> DataFrame:
    """The pivot table with a column per column key (given as ``column_values``, tuples for
    several keys, or read from the data) and value."""
    rows, columns, values = list(rows), list(columns), list(values)
    long_df, rk, sk, cks, vs = _long(df, rows, columns, values, agg, margins)
    r = (lambda c: F.round(c, round_to)) if round_to is not None else (lambda c: c)
    if not columns:
        cells = [(r(F.col(v)), c) for v, c in zip(vs, values)]
        out = long_df
    else:
        types = [df.schema[c].dataType for c in columns]
        if column_values is None:
            keys = pivot_keys(df.where(_present(rows + columns)), columns,
                              key_code([col(c) for c in columns], types))
        else:
            keys = given_keys(df.sparkSession, column_values, types)
        keys = [(code, "_".join(str(x) for x in k)) for code, k in keys]
        if margins:
            keys.append((TOTAL_CODE, TOTAL))
        out = (long_df.groupBy("_lvl", *rk, *sk).pivot("_ck", [code for code, _ in keys])
               .agg(F.struct(*[F.first(F.col(v), ignorenulls=True).alias(v) for v in vs]).alias("c")))
        taken, cells = {c.lower() for c in rows}, []
        if margins:         # the margin keeps its name
            keys = keys[-1:] + keys[:-1]
        named = {}
        for v, c in zip(vs, values):
            for code, label in keys:
                name = base_name = f"{c}_{label}".strip("_") if len(values) > 1 else label
                n = 1
                while name.lower() in taken:
                    n += 1
                    name = f"{base_name} ({n})"
                taken.add(name.lower())
                named[v, code] = name
        if margins:
            keys = keys[1:] + keys[:1]
        for v in vs:
            for code, _ in keys:
                cells.append((r(F.col(f"`{code}`.{v}")), named[v, code]))
    places = [f"_o{i}" for i in range(len(cells))]
    out = out.select("_lvl", *rk, *sk, *[e.alias(o) for (e, _), o in zip(cells, places)])
    # drop rows whose cells are all empty
    any_cell = F.lit(False)
    for o in places:
        any_cell = any_cell | F.col(o).isNotNull()
    out = out.where(any_cell).orderBy("_lvl", *sk)
    shown = [(cell_text(F.col(o)) if as_text else F.col(o)).alias(n)
             for o, (_, n) in zip(places, cells)]
    return out.select(*[F.col(k).alias(c) for k, c in zip(rk, rows)], *shown)
