"""Records of CSV files whose quoted cells may hold line breaks, read by splits of a file.

Spark's text source cuts files into byte ranges that begin and end at line breaks, so the only
thing that a task cannot know is whether its range begins inside a quoted cell. A line does one of
four things to that state: it leaves it, flips it, or ends outside or inside whatever came before.
A first pass folds the lines of every range into such a step, a prefix scan over one row per range
then gives each range the state it begins in, and a second pass joins lines to records with that
state known. Only records that cross a range's border meet in a shuffle.

A quote opens a cell at the cell's start alone; inside, two quotes are a quote; what follows a
closing quote up to the separator belongs to the cell. So a stray quote in an unquoted cell opens
nothing. Both passes take a line's step from one expression (``line_steps``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

BROADCAST_RANGES = 20_000
KEEP, FLIP, OUT, IN = 0, 1, 2, 3        # what a line does to the state "inside a quoted cell"
RECORD = "file string, owner bigint, block bigint, header boolean, record string"


def _end_state(line: Column, sep: str, start: int) -> Column:
    """State after a line that begins in ``start``: 0 at a cell's start, 1 inside quotes, 2 behind
    a closing quote, 3 inside an unquoted cell. Each quote is one step over the text before it."""
    def step(state, before):
        at_start = F.when(before.endswith(sep), 1).otherwise(3)
        return (F.when(state == 1, F.lit(2))
                .when((state == 3) & (before == ""), F.lit(3))
                .when(before == "", F.lit(1))
                .otherwise(at_start))
    parts = F.split(line, '"', -1)
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(start), step)


def line_steps(line: Column, sep: str = ",") -> Column:
    """KEEP, FLIP, OUT or IN of a line."""
    out, inside = _end_state(line, sep, 0) == 1, _end_state(line, sep, 1) == 1
    return (F.when(F.instr(line, '"') == 0, KEEP)
            .when(out & inside, IN).when(out, FLIP).when(inside, KEEP).otherwise(OUT))


def lines_of(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """file, block (first byte of the range), line, step. Carriage returns stay in the line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("value").alias("line"), line_steps(F.col("value"), sep).alias("step"))


def ranges(lines: DataFrame) -> DataFrame:
    """file, block, inside, owner of every range: whether it begins inside a quoted cell, and the
    range in which the record that it goes on with begins."""
    steps = F.when(F.col("step") != KEEP, F.struct("at", "step"))
    folded = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file", "block") \
        .agg(F.sort_array(F.collect_list(steps)).alias("s"))

    def after(state, x):
        return F.when(x["step"] == IN, True).when(x["step"] == OUT, False).otherwise(~state)

    def fold(acc, x):
        return F.struct(after(acc["o"], x).alias("o"), after(acc["i"], x).alias("i"),
                        (acc["closed"] | ~after(acc["i"], x)).alias("closed"))
    f = F.aggregate("s", F.struct(F.lit(False).alias("o"), F.lit(True).alias("i"), F.lit(False).alias("closed")), fold)
    got = folded.select("file", "block", f.alias("f")).select("file", "block", "f.*")
    # One row per range: a range that ends alike from both states fixes the state, others flip or keep it.
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum((F.col("o") & ~F.col("i")).cast("int"))
    fixed = F.when(F.col("o") == F.col("i"), F.struct("o", F.col("n").alias("n")))
    got = got.withColumn("n", flips.over(w)).withColumn("last", F.last(fixed, ignorenulls=True).over(before))
    odd = (F.coalesce(F.lag("n").over(w), F.lit(0)) - F.coalesce("last.n", F.lit(0))) % 2 == 1
    got = got.withColumn("inside", F.coalesce("last.o", F.lit(False)) != odd)
    opens = F.when(F.col("inside"), F.col("i") & F.col("closed")).otherwise(F.col("o"))
    return got.withColumn("owner", F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)) \
        .select("file", "block", "inside", "owner")


NAMES = ["file", "owner", "block", "header", "record"]


def _join_lines(batches):
    """Records of lines in order. ``owner`` is set on the parts of records that cross ranges: the
    range in which such a record begins. ``header`` marks (the first part of) a file's first record."""
    key, inside, parts, owner, first, done = None, False, [], None, False, []

    def put(owner):
        nonlocal parts
        done.append((*key[:1], owner, key[1], first, "\n".join(parts)))
        parts = []

    def batch():
        nonlocal done
        got, done = done, []
        return pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in got], schema=SCHEMA)

    for b in batches:
        lines, step = b.column("line"), b.column("step").to_numpy()
        block, file = b.column("block").to_numpy(), b.column("file")
        new = np.ones(len(b), bool)         # a range begins, as far as this batch tells
        new[1:] = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        stops = np.flatnonzero(new | (step != KEEP)).tolist()
        for i, z in zip(stops, [*stops[1:], len(b)]):
            if new[i] and (file[i].as_py(), int(block[i])) != key:
                if parts:                   # goes on in the next range, or the file ends
                    put(key[1] if owner is None else owner)
                key = file[i].as_py(), int(block[i])
                inside, first = b.column("inside")[i].as_py(), key[1] == 0
                owner = b.column("owner")[i].as_py() if inside else None
            # Line i, then lines that leave the state as it is, up to z.
            inside = (inside, not inside, False, True)[step[i]]
            parts.append(lines[i].as_py())
            at = i + 1
            if not inside:
                put(owner)
                owner, first = None, False
                if at < z:
                    yield batch()
                    n = z - at
                    yield pa.RecordBatch.from_arrays(
                        [file[at:z], pa.nulls(n, pa.int64()), pa.array(block[at:z]), pa.array(np.zeros(n, bool)), lines[at:z]], schema=SCHEMA)
            else:
                parts += lines[at:z].to_pylist()
        yield batch()
    if parts:
        put(key[1] if owner is None else owner)
        yield batch()


SCHEMA = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("header", pa.bool_()),
                    ("record", pa.string())])


def records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """record: the text of every record behind each file's first one; blank lines go."""
    lines = lines_of(spark, path, sep)
    checkpoint_dir(spark)
    state = ranges(lines).checkpoint(eager=True)
    w = Window.partitionBy("file").orderBy("block")
    state = state.withColumn("edge", F.col("inside") | F.coalesce(F.lead("inside").over(w), F.lit(False)))
    few = state.count() <= BROADCAST_RANGES

    def joined(part: DataFrame) -> DataFrame:
        if few:         # the lines are not shuffled and keep their order
            rows = lines.join(F.broadcast(part), ["file", "block"])
        else:
            rows = lines.withColumn("at", F.monotonically_increasing_id()).join(part, ["file", "block"]) \
                .repartition("file", "block").sortWithinPartitions("file", "block", "at")
        return rows.select("file", "block", "line", "step", "inside", "owner").mapInArrow(_join_lines, RECORD)

    out = joined(state.drop("edge")).where(F.col("owner").isNull() & ~F.col("header")).select("record")
    crossing = state.where("edge").drop("edge")
    if not crossing.isEmpty():
        parts = joined(crossing).where(F.col("owner").isNotNull()).groupBy("file", "owner") \
            .agg(F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"))
        out = out.unionByName(parts.where(~F.col("header")).select(F.array_join("p.record", "\n").alias("record")))
    text = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return out.select(text.alias("record")).where(F.col("record") != "")
