"""Helpers shared by the corpus operators: words, regex spans, scratch tables, size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

# Word characters are everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    root = spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def fs_path(uri: str):
    """(file system, path) of a shared folder, for reading and writing raw files in tasks."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and every later
    reader sees the same rows after an executor is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_tidy(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and Spark drops the shuffle files of the run as soon as the table is written: the
    next step's shuffle finds the disks free."""
    spark = df.sparkSession
    was = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        return stored(df, name)
    finally:
        spark.conf.set(TIDY, was)


def dealt(df: DataFrame, most: int = 20_000) -> DataFrame:
    """Deal few rows that each stand for much work (a file, a block) evenly over tasks: one a
    task, or several beyond ``most`` tasks. Without a number Spark would join such small tasks."""
    return df.repartition(max(1, min(df.count(), most)))


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast if it is counted to hold at most ``rows`` rows; else leave the
    join to Spark, which shuffles both sides and splits skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), 0)


BLOCK = 256


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start,end,match,kind>> of all leftmost non-overlapping matches.

    The pieces between matches (``split``) and the matches themselves alternate, so their
    lengths add up to the code point offsets; sums run within blocks of matches and then over
    blocks, so that a text of very many matches stays cheap. ``keep`` filters on the match.
    """
    offsets = "array<struct<s:int,e:int>>"

    def run(part):
        return F.aggregate(
            part, F.struct(F.lit(0).alias("p"), F.array().cast(offsets).alias("a")),
            lambda acc, x: F.struct(
                (acc["p"] + x["g"] + x["m"]).alias("p"),
                F.concat(acc["a"], F.array(F.struct((acc["p"] + x["g"]).alias("s"),
                                                    (acc["p"] + x["g"] + x["m"]).alias("e")))).alias("a")))

    def place(blocks):
        first = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(
            acc, F.array(F.element_at(acc, -1) + b["p"])))
        return F.flatten(F.zip_with(blocks, F.slice(first, 1, F.size(blocks)), lambda b, o: F.transform(
            b["a"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e")))))

    def locate(got):
        gap = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        both = F.zip_with(F.slice(gap, 1, F.size(got)), F.transform(got, lambda x: F.length(x)),
                          lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        at = bind(both, lambda p: bind(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")),
            lambda i: run(F.slice(p, i * BLOCK + 1, BLOCK))), place))
        return F.zip_with(at, got, lambda p, m: F.struct(
            p["s"].alias("start"), p["e"].alias("end"), m.alias("match"), F.lit(kind).alias("kind")))

    out = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), locate)
    if keep is not None:
        out = F.filter(out, lambda s: keep(s["match"]))
    empty = F.array().cast("array<struct<start:int,end:int,match:string,kind:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(empty)


def digest(found: Column, kinds: Iterable[str]) -> Column:
    """'kind:start:end' by start, then by the order of ``kinds``, joined by commas."""
    kinds = list(kinds)
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    mine = F.filter(found, lambda s: s["kind"].isin(kinds))
    rows = F.array_sort(F.transform(mine, lambda s: F.struct(
        s["start"], order[s["kind"]].alias("o"), s["end"], s["kind"])))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not hold (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running(df: DataFrame, by: list[str], at: str, value: str, out: str, stride: int = 4096) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows of the same ``by`` with a smaller whole number
    ``at``, which is unique there (neither is null). Sums run within ranges of ``stride`` numbers and
    then over the ranges, so no task sorts more than one row in ``stride``."""
    wide, total, before = fresh(df, "_wide"), fresh(df, "_total"), fresh(df, "_before")
    df = df.withColumn(wide, F.floor(F.col(at) / stride))
    earlier = lambda keys, o: Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = df.groupBy(*by, wide).agg(F.sum(value).alias(total))
    ranges = ranges.select(*by, wide, zero(total, earlier(by, wide)).alias(before))
    return df.withColumn(out, zero(value, earlier([*by, wide], at))).join(ranges, [*by, wide]) \
        .withColumn(out, F.col(out) + F.col(before)).drop(wide, before)
