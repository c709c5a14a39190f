"""Exact quantiles with linear interpolation, by radix selection over all groups and targets at once.

Spark's exact ``percentile`` merges a map of every distinct value of a group in one task; on a
column of 10^12 distinct doubles that does not fit. Here each value has an order-preserving whole
number, the bits of the double (``ordered_bits``), and selection goes down its digits:

1. values are counted by group and by sign and scaled logarithm, which grows with the value and is
   cheap, with the least and greatest value of each bucket; running counts over a group's buckets
   place each target rank in one of them;
2. a rank whose bucket holds one distinct value, or that asks for the bucket's least or greatest
   one, is answered; large buckets of the others are counted by the bits of the mantissa, some at
   a time, until each holds few values;
3. the values of what is left are counted by value and ranked.

Counts are summed map-side, so a hot group or a hot value is a few rows of the shuffle. No task
sees more than the buckets of a group or the values of one small bucket, whatever the values'
density: a spike of distinct values in a narrow interval is cut by the next digits. Every group
takes this path, and it ends after 52 bits of the mantissa at the latest. Whole numbers and prices
are mostly answered by the first count.

The interpolation is ``x_lo + (x_hi - x_lo) * frac`` at position ``p * (n - 1)``, which is
what pandas, NumPy and DuckDB's ``quantile_cont`` compute. Rows with a missing key have no group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import col
from quarry.session import checkpoint_dir

DEFAULT_ACCURACY = 10000
DEFAULT_BUCKETS = 1024
BROADCAST_GROUPS = 20_000    # bounds of some hundred bytes each


def join_facts(data: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the facts of each row's group (one row per group) to the rows.

    The facts are checkpointed and counted: up to ``BROADCAST_GROUPS`` of them are broadcast, so
    that no row is shuffled by a hot key; beyond that Spark joins both sides and splits skewed
    partitions. Without keys the facts are a single row."""
    checkpoint_dir(data.sparkSession)
    facts = facts.checkpoint(eager=True)
    if not keys:
        return data.crossJoin(F.broadcast(facts))
    few = facts.count() <= BROADCAST_GROUPS
    return data.join(F.broadcast(facts) if few else facts, list(keys))


def ordered_bits(v: Column) -> Column:
    """A bigint that orders like the double ``v``: its bits, negated for negative numbers."""
    a = F.abs(v)
    e = F.coalesce(F.floor(F.log2(a)), F.lit(-1022))        # the logarithm may round across a power of two
    e = F.least(F.greatest(e, F.lit(-1022)), F.lit(1023)).cast("double")
    two = F.lit(2.0)
    e = F.when(F.pow(two, e) > a, F.greatest(e - 1, F.lit(-1022.0))).when(F.pow(two, e + 1) <= a, e + 1).otherwise(e)
    whole = (e + 1022).cast("bigint") * F.lit(1 << 52) + (a / F.pow(two, e) * float(1 << 52)).cast("bigint")
    bits = F.when(a == float("inf"), F.lit(2047 << 52)).otherwise(whole)
    return F.when(v < 0, -bits).otherwise(bits)


def _coarse(parts: int) -> Column:
    """A whole number that grows with the value: its sign and logarithm, ``parts`` for each power of
    two. Java's logarithm never falls where its argument grows."""
    v = F.col("_v")
    a = F.abs(v)
    size = F.when(a == float("inf"), F.lit(2048)).otherwise(F.coalesce(F.log2(a), F.lit(-1075.0)) + 1075.0)
    return F.floor(F.when(v < 0, -1.0 - size).otherwise(size) * parts)


def _digit(parts: int, shift: int | None) -> Column:
    """The bucket of a value: by its logarithm, and below that by its bits down to ``shift``."""
    low = F.lit(0).cast("bigint") if shift is None else F.shiftright(ordered_bits(F.col("_v")), shift)
    return F.struct(_coarse(parts).alias("log"), low.alias("bits"))


def _inside(counts: DataFrame, keys: list[str], by: list[str], digit: str) -> DataFrame:
    """Add the running count before each bucket within what ``keys`` and ``by`` name."""
    w = Window.partitionBy(*[col(k) for k in keys], *by).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))


def quantiles_long(long_df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float],
                   accuracy: int = DEFAULT_ACCURACY, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Exact quantiles of ``value`` for each group of ``keys``.

    ``long_df`` holds ``keys`` and ``value``; missing values are ignored. Returns
    ``keys + [p, q]`` with one row per group and target. Buckets of up to ``20 * accuracy``
    values are ranked at once; each level cuts a bucket into ``buckets`` (a power of two) parts.
    """
    keys = list(keys)
    ps = [float(p) for p in ps]
    kc = [col(k) for k in keys]
    checkpoint_dir(long_df.sparkSession)
    v = F.col("_v")
    data = long_df.select(*kc, (col(value).cast("double") + 0.0).alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    for k in kc:
        data = data.where(k.isNotNull())
    bits = max(1, buckets.bit_length() - 1)
    shift = None
    facts = [F.count(F.lit(1)).alias("_c"), F.min(v).alias("_mn"), F.max(v).alias("_mx")]

    counts = _inside(data.groupBy(*kc, _digit(buckets, shift).alias("_d")).agg(*facts), keys, [], "_d") \
        .withColumn("_n", F.sum("_c").over(Window.partitionBy(*kc)))
    # both order statistics of each target; a rank falls into one bucket of its group
    ranks = F.array(*[F.struct(F.lit(t).alias("_t"), F.lit(side).alias("_s"),
                               fn(F.lit(p) * (F.col("_n") - 1)).cast("bigint").alias("_r"))
                      for t, p in enumerate(ps) for side, fn in ((0, F.floor), (1, F.ceil))])
    mine = F.filter(ranks, lambda r: (r["_r"] >= F.col("_before")) & (r["_r"] < F.col("_before") + F.col("_c")))
    found = counts.select(*kc, "_n", "_d", "_c", "_mn", "_mx", "_before", F.explode(mine).alias("_x")) \
        .select(*kc, "_n", "_x._t", "_x._s", "_d", "_c", "_mn", "_mx", (F.col("_x._r") - F.col("_before")).alias("_r"))
    least = F.col("_mn")
    answer = F.when((least == F.col("_mx")) | (F.col("_r") == 0), least).when(F.col("_r") == F.col("_c") - 1, F.col("_mx"))
    found = found.withColumn("_a", answer).checkpoint(eager=True)
    done = found.where(F.col("_a").isNotNull()).select(*kc, "_n", "_t", "_s", "_a")
    left = found.where(F.col("_a").isNull())
    while True:
        most = left.agg(F.max("_c")).first()[0]
        if most is None:
            break
        asked = left.groupBy(*kc).agg(F.collect_set("_d").alias("_want"))    # two for each target at most
        part = join_facts(data, asked, keys).withColumn("_d", _digit(buckets, shift)).where(F.array_contains("_want", F.col("_d")))
        targets = left.select(*kc, "_n", "_t", "_s", "_d", "_r")
        if most <= 20 * accuracy:
            last = _inside(part.groupBy(*kc, "_d", "_v").agg(F.count(F.lit(1)).alias("_c")), keys, ["_d"], "_v")
            hit = (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c"))
            done = done.unionByName(last.join(targets, [*keys, "_d"]).where(hit)
                                    .select(*kc, "_n", "_t", "_s", F.col("_v").alias("_a")))
            break
        shift = max(0, (52 if shift is None else shift) - bits)
        finer = _inside(part.groupBy(*kc, "_d", _digit(buckets, shift).alias("_e")).agg(*facts), keys, ["_d"], "_e")
        hit = (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c"))
        found = finer.join(targets, [*keys, "_d"]).where(hit) \
            .select(*kc, "_n", "_t", "_s", F.col("_e").alias("_d"), "_c", "_mn", "_mx", (F.col("_r") - F.col("_before")).alias("_r")) \
            .withColumn("_a", answer).checkpoint(eager=True)
        done = done.unionByName(found.where(F.col("_a").isNotNull()).select(*kc, "_n", "_t", "_s", "_a"))
        left = found.where(F.col("_a").isNull())

    both = done.groupBy(*kc, "_n", "_t").agg(F.max(F.when(F.col("_s") == 0, F.col("_a"))).alias("_lo"),
                                             F.max(F.when(F.col("_s") == 1, F.col("_a"))).alias("_hi"))
    p = F.array(*[F.lit(x) for x in ps])[F.col("_t")]
    pos = p * (F.col("_n") - 1)
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))
    return both.select(*kc, p.alias("p"), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(q).alias("q"))


def stack_columns(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                  name: str = "column", value: str = "value") -> DataFrame:
    """Long form ``keys + [name, value]`` of numeric columns (values cast to double)."""
    if not cols:
        raise ValueError("no columns to stack")
    arr = F.array(*[F.struct(F.lit(c).alias(name), col(c).cast("double").alias(value))
                    for c in cols])
    return df.select(*[col(k) for k in keys], F.inline(arr))


def quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float],
              by: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Exact quantiles of several columns: rows ``by + [column, p, q]``."""
    long_df = stack_columns(df, cols, by)
    return quantiles_long(long_df, list(by) + ["column"], "value", ps, accuracy)


def quantiles_wide(df: DataFrame, cols: Sequence[str], ps: Sequence[float],
                   by: Sequence[str] = (), names: Sequence[str] | None = None,
                   accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Rows ``by + [column] + names`` with one column per target quantile."""
    names = list(names or [f"p{int(round(p * 100))}" for p in ps])
    q = quantiles(df, cols, ps, by, accuracy)
    keys = list(by) + ["column"]
    return (q.groupBy(*keys)
            .agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(nm)
                   for p, nm in zip(ps, names)]))
