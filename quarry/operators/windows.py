"""Order-dependent operators: forward fill, rolling mean, stacked areas, running index.

Spark rows have no order, so each operator takes an explicit ``order_by``. A window with no
partition key would pull every row into one task; instead the rows are cut into slices of the
order, of bounded size even when one group or one first-key value is hot, and each slice's facts
(row counts, last non-missing value) go into a small table of one row per slice and group. A
window over that small table carries values across slice borders, and a join brings them back.

The borders of the slices are quantiles of a sample of the keys, some per slice, stored as a table
of one row with a reliable ``checkpoint()``. The slice of a row is then a function of its key alone
(a binary search in the stored borders), so that the facts and the rows may be read in separate
passes, a lost executor's rows come back to the same slices, and the rows themselves are shuffled
once and written nowhere. Time frames (``rolling_mean_time``) number their narrow rows in one
range sort that is checkpointed instead.

Groups are contiguous in the order, so only the first group of a slice can have begun in an
earlier one: the values carried over borders are at most one row per slice (a number set by the
shuffle settings, not by the data), which is why that table is broadcast.

Rows equal in all of ``order_by`` follow a hash of their cells, the same on every run; add a
tie-break column for another order. Tables must give the same rows whenever they are read.
Helper columns take names that the table does not have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import check_columns, col, free_names, nan_as_missing, nan_to_null
from quarry.session import checkpoint_dir

#: Sampled keys per slice of the order, and at most in all.
SAMPLED, MOST_SAMPLED = 64, 1_000_000


def _with_slices(df: DataFrame, keys: Sequence[str], pid: str) -> DataFrame:
    """Add ``pid``: the number of the row's slice in the order of ``keys``, missing values first."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if slices < 2:
        return df.withColumn(pid, F.lit(0))
    checkpoint_dir(df.sparkSession)
    key = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    seen = df.select(key.alias("k"))
    share = min(SAMPLED * slices, MOST_SAMPLED) / max(seen.count(), 1)
    sample = (seen.sample(share, seed=7) if share < 1 else seen).agg(F.sort_array(F.collect_list("k")).alias("s"))
    (cuts,) = free_names(df, "cuts")
    at = lambda i: F.get("s", F.floor(i.cast("long") * F.size("s") / slices).cast("int"))
    borders = sample.select(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), at)).alias(cuts)) \
        .checkpoint(eager=True)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(slices.bit_length()))])
    n = F.aggregate(steps, F.lit(0),
                    lambda n, step: F.when(F.get(F.col(cuts), n + step - 1) <= key, n + step).otherwise(n))
    return df.crossJoin(F.broadcast(borders)).withColumn(pid, n).drop(cuts)     # one row of borders


def _cells_hash(df: DataFrame) -> Column:
    """Order of rows that are equal in their keys."""
    plain = [f.name for f in df.schema.fields
             if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[col(c) for c in plain]) if plain else F.lit(0).cast("long")


def _sorted_with_ids(df: DataFrame, keys: Sequence[str], rid: str, pid: str) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return (df.orderBy(*[col(k) for k in keys])
            .withColumn(rid, F.monotonically_increasing_id())
            .withColumn(pid, F.shiftright(F.col(rid), 33))
            .checkpoint(eager=True))


def _carried(per_part: DataFrame, p: Sequence[str], pid: str, value: Column, name: str) -> DataFrame:
    """Rows of ``per_part`` (one per slice and group) whose group began in an earlier slice,
    with ``value`` over those earlier rows: at most one per slice."""
    w = Window.partitionBy(*[col(k) for k in p]).orderBy(pid) \
        .rowsBetween(Window.unboundedPreceding, -1)
    out = per_part.select(pid, *[col(k) for k in p], value.over(w).alias(name))
    return out.where(F.col(name).isNotNull())


def _join_carried(rows: DataFrame, carried: DataFrame, p: Sequence[str], pid: str) -> DataFrame:
    same = F.col("s." + pid) == F.col("c." + pid)
    for k in p:
        same = same & F.col(f"s.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    return rows.alias("s").join(F.broadcast(carried.alias("c")), same, "left")


def ordered_index(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                  name: str = "row_index") -> DataFrame:
    """Add ``name``: 0-based position of each row in ``order_by`` order within its
    ``partition_by`` group (a distributed ``row_number() - 1``); missing keys form a group."""
    p, o = list(partition_by), list(order_by)
    check_columns(df, p + o)
    pid, at, n, before, tie = free_names(df, "pid", "at", "n", "before", "tie")
    s = _with_slices(df, p + o, pid).withColumn(tie, _cells_hash(df))
    per_part = s.groupBy(pid, *[col(k) for k in p]).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(pid, *[col(k) for k in p]).orderBy(*[col(k) for k in o], tie)
    s = s.withColumn(at, F.row_number().over(w) - 1)
    j = _join_carried(s, _carried(per_part, p, pid, F.sum(n), before), p, pid)
    return j.select(*[F.col(f"s.`{c}`") for c in df.columns],
                    (F.coalesce(F.col(before), F.lit(0)) + F.col(at)).cast("long").alias(name))


def forward_fill(df: DataFrame, c: str, order_by: Sequence[str],
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Fill missing cells of ``c`` with the last earlier non-missing value in ``order_by``
    order (within ``partition_by`` groups). Leading missing cells stay missing."""
    p, o = list(partition_by), list(order_by)
    if not o:
        raise ValueError("forward fill needs order_by (Spark rows have no order of their own)")
    check_columns(df, [c] + p + o)
    pid, x, upto, prev, within, tie = free_names(df, "pid", "x", "upto", "prev", "within", "tie")
    dt = df.schema[c].dataType
    val = nan_to_null(col(c)).cast(dt) if dt.typeName() in ("double", "float") else col(c)
    s = _with_slices(df, p + o, pid).withColumn(x, val).withColumn(tie, _cells_hash(df))
    # last non-missing value of each (slice, group)
    place = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(o)], F.col(tie).alias("tie"))
    per_part = (s.groupBy(pid, *[col(k) for k in p])
                .agg(F.max_by(x, F.when(F.col(x).isNotNull(), place)).alias(upto)))
    carried = _carried(per_part, p, pid, F.last(upto, ignorenulls=True), prev)
    w = Window.partitionBy(pid, *[col(k) for k in p]).orderBy(*[col(k) for k in o], tie) \
        .rowsBetween(Window.unboundedPreceding, 0)
    out = _join_carried(s.withColumn(within, F.last(x, ignorenulls=True).over(w)), carried, p, pid)
    filled = F.coalesce(F.col(within), F.col(prev)).cast(dt).alias(c)
    return out.select(*[filled if y == c else F.col(f"s.`{y}`") for y in df.columns])


@nan_as_missing
def rolling_mean(df: DataFrame, y: str, order_by: Sequence[str], n: int,
                 partition_by: Sequence[str] = (), min_periods: int | None = None,
                 name: str | None = None, chunk: int = 1_000_000) -> DataFrame:
    """Mean of the last ``n`` rows (current included) in ``order_by`` order.

    Like pandas' ``rolling(n, min_periods).mean()``: missing values are skipped, and fewer
    than ``min_periods`` (default ``n``) present values give NULL. Rows are numbered
    (``ordered_index``) and cut into chunks of ``chunk`` rows; each chunk also receives a
    copy of the previous chunk's last ``n - 1`` rows, so every window frame lies inside one
    chunk and no task holds more than ``chunk + n - 1`` rows.
    """
    if n < 1:
        raise ValueError("window size must be positive")
    p, o = list(partition_by), list(order_by)
    check_columns(df, [y] + p + o)
    chunk = max(chunk, n)
    min_periods = n if min_periods is None else min_periods
    name = name or f"{y}_rolling_{n}"
    at, part, copy = free_names(df, "at", "part", "copy")
    idx = ordered_index(df, o, p, at)
    idx = idx.withColumn(part, F.floor(F.col(at) / chunk)).withColumn(copy, F.lit(False))
    tail = (idx.where((F.col(at) % chunk) >= chunk - (n - 1))
            .withColumn(part, F.col(part) + 1).withColumn(copy, F.lit(True))) \
        if n > 1 else None
    both = idx.unionByName(tail) if tail is not None else idx
    w = Window.partitionBy(*[col(k) for k in p], part).orderBy(at).rowsBetween(-(n - 1), 0)
    v = col(y).cast("double")
    out = both.withColumn(name, F.when(F.count(v).over(w) >= min_periods, F.avg(v).over(w)))
    return out.where(~F.col(copy)).select(*[col(c) for c in df.columns], col(name))


def _pieces_of(lo: Column, hi: Column, levels: int) -> Column:
    """The blocks ``lo`` to ``hi - 1`` as array<struct<level, k>>: at most two for each level, where
    (level, k) stands for the blocks from ``k * 2 ** level`` to ``(k + 1) * 2 ** level - 1``."""
    def step(acc, level):
        left = (acc["lo"] % 2 == 1) & (acc["lo"] < acc["hi"])
        lo = acc["lo"] + left.cast("long")
        right = (acc["hi"] % 2 == 1) & (lo < acc["hi"])
        hi = acc["hi"] - right.cast("long")
        node = lambda k: F.struct(level.alias("level"), k.alias("k"))
        none = F.array().cast("array<struct<level:int,k:bigint>>")
        got = F.concat(acc["got"], F.when(left, F.array(node(acc["lo"]))).otherwise(none),
                       F.when(right, F.array(node(hi))).otherwise(none))
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), got.alias("got"))
    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"),
                     F.array().cast("array<struct<level:int,k:bigint>>").alias("got"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["got"])


@nan_as_missing
def rolling_mean_time(df: DataFrame, y: str, ts: str, seconds: float,
                      partition_by: Sequence[str] = (), min_periods: int = 1,
                      name: str | None = None, block: int = 256, spans: int | None = None) -> DataFrame:
    """Mean of ``y`` over the rows of the last ``seconds`` up to each row's time, itself included.

    The frame is ``(t - seconds, t]``; rows of the same time share a frame, missing values are
    skipped, and fewer than ``min_periods`` present values or a missing time give NULL.

    Rows are summed per time first. Times and the starts of their frames are then numbered in one
    range sort, which turns each frame into a run of row numbers. Numbers are cut into blocks of
    ``block`` rows: a frame is the end of one block, whole blocks, and the beginning of another
    (or lies inside one). Whole blocks come from a table of sums over 1, 2, 4, ... blocks, so that
    no task holds more than a block or a slice of the sort, however many rows a frame spans, and
    sums are never differences of larger ones. The means return to the rows by a join on group and
    time, whose skewed partitions Spark splits. ``spans``, of an earlier version, has no effect.
    """
    p = list(partition_by)
    check_columns(df, [y, ts] + p)
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    span = int(round(seconds * 1_000_000))
    name = name or f"{y}_rolling_{seconds:g}s"
    t, mark = free_names(df, "t", "mark")
    v = col(y).cast("double")
    gk = [f"g{i}" for i in range(len(p))]
    # a zone-less time counts from the zone-less epoch, whatever the session's zone
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", epoch, col(ts))
    else:
        micros = F.unix_micros(col(ts).cast("timestamp"))
    rows = df.withColumn(t, micros)
    cells = (rows.where(F.col(t).isNotNull())
             .groupBy(*[col(k).alias(g) for k, g in zip(p, gk)], F.col(t).alias("t"))
             .agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("n")))
    f = _frames(cells, gk, span).withColumn("b", F.floor(F.col("i") / block)) \
        .withColumn("first", F.floor(F.col("lo") / block)).checkpoint(eager=True)
    here = Window.partitionBy(*gk, "b")
    up = here.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    down = here.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    near = here.orderBy("t").rangeBetween(-(span - 1), 0)
    s = f.select("*", *[F.sum(c).over(w).alias(f"{c}_{k}") for c in ("total", "n")
                        for k, w in (("up", up), ("down", down), ("near", near))])

    def join(left: DataFrame, right: DataFrame, on: dict) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        same = F.lit(True)
        for g in gk:
            same = same & F.col(g).eqNullSafe(F.col(f"r_{g}"))
        for a, z in on.items():
            same = same & (F.col(a) == F.col(f"r_{z}"))
        return left.join(right, same, "left").drop(*[f"r_{c}" for c in (*gk, *on.values())])

    # the rest of the block in which the frame begins
    ends = s.select(*gk, "i", F.col("total_down").alias("total_end"), F.col("n_down").alias("n_end"))
    s = join(s.withColumn("from", F.when(F.col("b") > F.col("first"), F.col("lo"))), ends, {"from": "i"})
    most = f.agg(F.max(F.col("b") - F.col("first")).alias("w"), F.max("b").alias("b")).first()
    total, n = F.col("total_up") + F.coalesce("r_total_end", F.lit(0.0)), F.col("n_up") + F.coalesce("r_n_end", F.lit(0))
    if (most["w"] or 0) > 1:
        levels = int(most["b"]).bit_length()
        nodes = f.groupBy(*gk, "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n")) \
            .select(*gk, "total", "n", "b", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")) \
            .groupBy(*gk, "level", F.expr("shiftright(b, level)").alias("k")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        runs = f.where(F.col("b") - F.col("first") > 1).select(*gk, "first", "b").distinct()
        parts = runs.select("*", F.explode(_pieces_of(F.col("first") + 1, F.col("b"), levels)).alias("p")) \
            .select(*gk, "first", "b", "p.level", "p.k")
        whole = join(parts, nodes, {"level": "level", "k": "k"}) \
            .groupBy(*gk, "first", "b").agg(F.sum("r_total").alias("total_mid"), F.sum("r_n").alias("n_mid"))
        s = join(s, whole, {"first": "first", "b": "b"})
        total, n = total + F.coalesce("r_total_mid", F.lit(0.0)), n + F.coalesce("r_n_mid", F.lit(0))
    one = F.col("b") == F.col("first")
    total, n = F.when(one, F.col("total_near")).otherwise(total), F.when(one, F.col("n_near")).otherwise(n)
    means = s.select(*[F.col(g).alias(f"{mark}_{g}") for g in gk], F.col("t").alias(mark),
                     F.when(n >= max(min_periods, 1), total / n).alias(name))
    same = F.col(t) == F.col(mark)
    for k, g in zip(p, gk):
        same = same & col(k).eqNullSafe(F.col(f"{mark}_{g}"))
    return rows.join(means, same, "left").select(*[col(c) for c in df.columns], col(name))


def _frames(cells: DataFrame, gk: list[str], span: int) -> DataFrame:
    """gk, t, total, n, i, lo of cells (gk, t, total, n): the cell's number in its group by time and
    that of the first cell later than ``t - span``."""
    ends = cells.select(*gk, "t", F.col("t").alias("time"), F.lit(False).alias("ask"), "total", "n")
    asks = cells.select(*gk, "t", (F.col("t") - span).alias("time"), F.lit(True).alias("ask"),
                        F.lit(None).cast("double").alias("total"), F.lit(None).cast("bigint").alias("n"))
    s = _sorted_with_ids(ends.unionByName(asks), gk + ["time", "ask"], "rid", "pid")
    one = (~F.col("ask")).cast("long")
    w = Window.partitionBy("pid", *gk).orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("at", F.sum(one).over(w))
    per_part = s.groupBy("pid", *gk).agg(F.sum(one).alias("cells"))
    j = _join_carried(s, _carried(per_part, gk, "pid", F.sum("cells"), "before"), gk, "pid")
    upto = F.coalesce("before", F.lit(0)) + F.col("at")
    ask = F.col("ask")
    return j.select(*[F.col(f"s.{g}").alias(g) for g in gk], "t", "ask", "total", "n", upto.alias("upto")) \
        .groupBy(*gk, "t").agg(F.max("total").alias("total"), F.max("n").alias("n"),
                               (F.max(F.when(~ask, F.col("upto"))) - 1).alias("i"), F.max(F.when(ask, F.col("upto"))).alias("lo"))


@nan_as_missing
def area_stack(df: DataFrame, x: str, y: str, color: str) -> DataFrame:
    """Stacked-area data: per x, the running total of y over colours (colour order).

    y is summed per (x, colour) first, so each window partition holds one row per colour."""
    check_columns(df, [x, y, color])
    from quarry.operators.aggregate import group_agg
    g = group_agg(df, x, y, "sum", color)
    w = Window.partitionBy(col(x)).orderBy(col(color)).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("stacked", F.sum(col(y)).over(w))


@nan_as_missing
def area_rows(df: DataFrame, x: str, y: str, color: str) -> DataFrame:
    """Every row of a stacked-area chart, by x and colour, with ``stacked``: the row's y on top of
    all y of the colours before its own at this x (a missing y is drawn at no height).

    Only one row per x and colour enters the window; the heights come back by a join whose skewed
    partitions Spark splits."""
    check_columns(df, [x, y, color])
    under, kx, kc, total = free_names(df, "under", "x", "c", "total")
    w = Window.partitionBy(kx).orderBy(kc).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(col(x).alias(kx), col(color).alias(kc)).agg(F.sum(col(y)).alias(total)) \
        .withColumn(under, F.sum(total).over(w)).drop(total)
    same = col(x).eqNullSafe(F.col(kx)) & col(color).eqNullSafe(F.col(kc))
    rows = df.select(*dict.fromkeys([x, color, y])).join(base, same)
    out = [col(c) for c in dict.fromkeys([x, color, y])]
    return rows.select(*out, (col(y) + F.coalesce(under, F.lit(0))).alias("stacked")).orderBy(col(x), col(color))
