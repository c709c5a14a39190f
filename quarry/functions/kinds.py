"""Column kinds (boolean, datetime, numerical, categorical, text, unknown)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import NUMERIC_TYPES, col, word_count

# Kind names and the text rule (mean word count above 4 means free text).
KINDS = ("boolean", "datetime", "numerical", "categorical", "text", "unknown")
TEXT_WORDS = 4


def _static_kind(dt: T.DataType) -> str | None:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, NUMERIC_TYPES):
        return "numerical"
    if isinstance(dt, T.StringType):
        return None  # decided by the data
    return "unknown"


def column_kinds(df: DataFrame, text_words: float = TEXT_WORDS) -> DataFrame:
    """One row per column: ``column, dtype, kind, avg_words``.

    All string columns are measured in one aggregate (mean word count of non-missing cells);
    other kinds follow from the schema.
    """
    strings = [f.name for f in df.schema.fields if _static_kind(f.dataType) is None]
    aggs = [F.avg(word_count(col(c))).alias(f"w{i}") for i, c in enumerate(strings)]
    base = df.agg(*aggs) if aggs else df.sparkSession.range(1).select()
    structs = []
    for f in df.schema.fields:
        k = _static_kind(f.dataType)
        if k is None:
            w = F.col(f"w{strings.index(f.name)}")
            kind = F.when(w > F.lit(text_words), "text").otherwise("categorical")
        else:
            w, kind = F.lit(None).cast("double"), F.lit(k)
        structs.append(F.struct(F.lit(f.name).alias("column"),
                                F.lit(f.dataType.simpleString()).alias("dtype"),
                                kind.alias("kind"), w.alias("avg_words")))
    return base.select(F.inline(F.array(*structs)))


def kinds_dict(df: DataFrame, text_words: float = TEXT_WORDS) -> dict[str, str]:
    """Column -> kind (collects one small row per column: a schema-shaping fact)."""
    return {r["column"]: r["kind"] for r in column_kinds(df, text_words).collect()}


def select_kind(df: DataFrame, *kinds: str) -> DataFrame:
    """Project the columns whose kind is one of ``kinds``."""
    k = kinds_dict(df)
    return df.select(*[col(c) for c in df.columns if k[c] in kinds])
