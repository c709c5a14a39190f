"""Small expression builders: null rules, safe arithmetic, adjusted moments, text helpers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)


def col(c: str | Column) -> Column:
    """Column for a name; names with dots or spaces are back-ticked so they are taken literally."""
    if isinstance(c, Column):
        return c
    return F.col(f"`{c}`") if not c.startswith("`") else F.col(c)


def check_columns(df: DataFrame, cols: Iterable[str | None]) -> None:
    """Raise ValueError naming every column that does not exist (None entries are ignored)."""
    names = set(df.columns)
    absent = [c for c in cols if c is not None and c not in names]
    if absent:
        raise ValueError(f"Columns not found: {absent}")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Helper column names that the table does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = "_" + w
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def dtype_of(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def is_numeric(df: DataFrame, c: str) -> bool:
    """Numbers count, booleans do not (as in pandas' number selector)."""
    return isinstance(dtype_of(df, c), NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL so that counts and aggregates treat it as missing (pandas ``isna`` rule)."""
    return F.nanvl(c, F.lit(None).cast("double"))


def missing(df: DataFrame, c: str) -> Column:
    """Predicate "cell is missing": NULL, or NaN for floating columns."""
    x = col(c)
    if isinstance(dtype_of(df, c), FRACTIONAL_TYPES):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL on a zero divisor instead of raising (ANSI mode)."""
    return F.try_divide(a, b)


def adjusted_skew(c: Column) -> Column:
    """Sample-adjusted skewness G1 = g1 * sqrt(n(n-1)) / (n-2); NULL below 3 values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(c: Column) -> Column:
    """Sample-adjusted excess kurtosis G2 = ((n+1) g2 + 6)(n-1) / ((n-2)(n-3)); NULL below 4."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def row_hash(seed: int, cols: Iterable[Column]) -> Column:
    """Seeded hash that orders rows at random, the same on every run: MD5 of the cells' text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def row_key(df: DataFrame) -> list[Column]:
    """Narrow columns that are equal for equal rows only (missing cells equal each other).

    The cells of plain columns enter one SHA-256 digest, each with its length, so that neighbouring
    cells cannot run together; arrays, structs, maps and text under a collation of its own stay as
    they are. Two different rows with one digest of 256 bits are taken not to occur.
    """
    cells, whole = [], []
    for f in df.schema.fields:
        x, t = col(f.name), f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            text = x.cast(T.TimestampNTZType()).cast("string") if isinstance(t, T.TimestampNTZType) \
                else F.unix_micros(x).cast("string")
        elif isinstance(t, T.BinaryType):
            text = F.hex(x)
        elif isinstance(t, FRACTIONAL_TYPES):
            text = (x + F.lit(0).cast(t)).cast("string")         # -0.0 equals 0.0
        elif t == T.StringType() or isinstance(t, (T.BooleanType, T.DateType, *NUMERIC_TYPES)):
            text = x.cast("string")
        else:
            whole.append(x)
            continue
        cells += [F.coalesce(F.octet_length(text).cast("string"), F.lit("-")), F.lit(":"),
                  F.coalesce(text, F.lit(""))]
    return ([F.unhex(F.sha2(F.concat(*cells).cast("binary"), 256)).alias("_digest")] if cells else []) + whole


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words (blank text has none)."""
    return F.regexp_count(c, F.lit(r"\S+"))


def cell_text(c: Column) -> Column:
    """Cell as text, missing shown as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def nan_as_missing(operator):
    """Let an operator see NaN of its table as NULL, which Spark's functions skip."""
    @wraps(operator)
    def run(df, *args, **kwargs):
        if any(isinstance(f.dataType, FRACTIONAL_TYPES) for f in df.schema.fields):
            df = df.select(*[nan_to_null(col(f.name)).cast(f.dataType).alias(f.name)
                             if isinstance(f.dataType, FRACTIONAL_TYPES) else col(f.name)
                             for f in df.schema.fields])
        return operator(df, *args, **kwargs)
    return run
