"""Sources and sinks: CSV with missing-value tokens and type inference, CSV / JSON / Parquet
writers, the three-table report and the report summary frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exprs import col, numeric_columns
from quarry.operators import profile as P

# Text read as missing (pandas' default list of missing-value markers).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null")

# candidate types, narrowest first
_CANDIDATES = (("boolean", "boolean"), ("bigint", "bigint"), ("double", "double"),
               ("timestamp", "timestamp"))


# Quotes are doubled inside quoted cells, which may hold line breaks; spaces belong to the cell.
QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# Options that the reader by splits knows; with any other, each file is read by one task.
_SPLIT_OPTIONS = {"sep", "delimiter", "header", "multiLine", "nullValue", "emptyValue", "mode"}


def _read_cells(spark: SparkSession, path: str | Sequence[str], options: dict) -> DataFrame:
    """All cells as text. Files are read by splits, also where cells hold line breaks; a first
    read takes the column names alone."""
    given = {**QUOTING, "header": True, "inferSchema": False, "multiLine": True, **options}
    whole = spark.read.options(**given).csv(path)
    sep = options.get("sep", options.get("delimiter", ","))
    plain = set(options) <= _SPLIT_OPTIONS and given["header"] is True and given["multiLine"] is True and len(sep) == 1
    if not plain or not whole.columns:
        return whole
    from quarry.sources.records import records
    rows = records(spark, path, sep)
    cells = {k: str(v).lower() if isinstance(v, bool) else v for k, v in given.items() if k not in ("header", "inferSchema", "multiLine")}
    parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(whole.columns))), cells)
    return rows.select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(whole.columns)])


def read_csv(spark: SparkSession, path: str | Sequence[str],
             null_tokens: Sequence[str] = NULL_TOKENS, infer: bool = True,
             **options) -> DataFrame:
    """CSV with a header row from any Hadoop file-system path or URI (file, hdfs, s3a, abfs).

    Large files are read by many tasks, also where quoted cells hold line breaks (``records``);
    files are UTF-8 and lines end in a line feed, with or without a carriage return. Options of
    the CSV source other than separator, null and empty value read each file as a whole.

    Cells equal to a null token become NULL. With ``infer`` each column takes the narrowest
    of boolean, bigint, double, timestamp that every present value parses as (one aggregate
    counting failed ``try_cast``s for all columns at once), else stays string. A token such
    as "NA" therefore no longer turns a number column into text.
    """
    raw = _read_cells(spark, path, options)
    tokens = list(null_tokens)
    clean = raw.select(*[F.when(~col(c).isin(tokens) & col(c).isNotNull(), col(c)).alias(c)
                         for c in raw.columns]) if tokens else raw
    if not infer:
        return clean
    checks = []
    for i, c in enumerate(clean.columns):
        x = col(c)
        for name, t in _CANDIDATES:
            if name == "boolean":
                bad = x.isNotNull() & ~F.lower(x).isin("true", "false")
            elif name == "timestamp":
                # a time of day alone has no date and stays text
                bad = x.isNotNull() & (F.try_to_timestamp(x).isNull() | ~x.rlike(r"^\s*\d{4}-\d"))
            else:
                bad = x.isNotNull() & x.try_cast(t).isNull()
            checks.append(F.count_if(bad).alias(f"{name}_{i}"))
        checks.append(F.count(x).alias(f"present_{i}"))
    fails = clean.agg(*checks).first() if checks else None
    out = []
    for i, c in enumerate(clean.columns):
        chosen = next((t for name, t in _CANDIDATES if fails[f"{name}_{i}"] == 0), None)
        if fails[f"present_{i}"] == 0:
            chosen = "double"       # an empty column
        if chosen == "timestamp":
            out.append(F.try_to_timestamp(col(c)).alias(c))
        elif chosen == "boolean":
            out.append((F.lower(col(c)) == "true").alias(c))
        elif chosen:
            out.append(col(c).try_cast(chosen).alias(c))
        else:
            out.append(col(c))
    return clean.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, no index (one file per task)."""
    df.write.mode(mode).options(header=True, **QUOTING).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def report_frames(df: DataFrame, preview_rows: int = 50,
                  order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the report page: describe, preview, meta, quality."""
    return {"describe": P.describe(df) if numeric_columns(df) else None,
            "preview": P.preview(df, preview_rows, order_by),
            "meta": P.meta(df), "quality": P.quality_table(df)}


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> dict[str, str]:
    """Three Parquet tables under ``path``: the data, numeric statistics (rounded to 3) and
    the quality sheet (column, missing %, distinct)."""
    out = {"data": f"{path}/data", "statistics": f"{path}/statistics",
           "quality": f"{path}/quality"}
    df.write.mode(mode).parquet(out["data"])
    if numeric_columns(df):
        P.describe(df, round_to=3).write.mode(mode).parquet(out["statistics"])
    P.quality_table(df).write.mode(mode).parquet(out["quality"])
    return out
