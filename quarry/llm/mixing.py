"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a fixed pseudo-random order, are cut into blocks of equal size. Block k of
a source of weight e out of p is released at slot floor(k p / e) and due at ceil((k + 1) p / e);
earliest deadline first gives every block a slot between the two, so at any slot each source is
less than one block away from its target. The schedule of one period of p slots repeats until a
source runs out; then the weights of the rest are scheduled anew (a phase), so every row is used
once.

Only the weights and block counts of the named sources (a bounded parameter) are handled on the
driver; a row finds its slot from its own block number. A row's place in its source comes from
sums over hash buckets and a window within its bucket, so a hot source is spread over as many
buckets as it needs.

Defined cases: sources without a weight of their own, also null ones, share the weight ``other``;
null sizes count as 0; rows of the same id, also null, are spread over the buckets by the rest of
their columns, and repeated rows (equal in all columns) get a place each, in one bucket; an empty
table gives an empty result; added columns take names that are free.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh, running

BUCKET_ROWS = 2000
MAX_SOURCES, MAX_PERIOD = 256, 4096


def period(weights: list[int]) -> list[int]:
    """Source index of each slot of one period, by earliest deadline first."""
    p = sum(weights)
    waiting = [(0, -(-p // e), i, 0) for i, e in enumerate(weights) if e]   # release, deadline, source, k
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(p):
        while waiting and waiting[0][0] <= slot:
            r, d, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (d, i, k))
        d, i, k = heapq.heappop(ready)
        out.append(i)
        e, k = weights[i], k + 1
        if k < e:
            heapq.heappush(waiting, (k * p // e, -(-(k + 1) * p // e), i, k))
    return out


def phases(weights: dict[str, int], blocks: dict[str, int]) -> dict[str, list[tuple]]:
    """Per source: (first block, first slot, period, slots in the period) of each phase."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    plan: dict[str, list[tuple]] = {s: [] for s in left}
    slot = 0
    while left:
        names = sorted(left)
        order = period([weights[s] for s in names])
        rounds = min(-(-left[s] // weights[s]) for s in names)
        for i, s in enumerate(names):
            plan[s].append((used[s], slot, len(order), [t for t, j in enumerate(order) if j == i]))
            used[s] += rounds * weights[s]
        slot += rounds * len(order)
        left = {s: n - rounds * weights[s] for s, n in left.items() if n > rounds * weights[s]}
    return plan


def mix(df: DataFrame, weights: dict[str, int], other: int = 1, source: str = "source",
        size: Column | None = None, block: int = 65_536, id_col: str = "doc_id") -> DataFrame:
    """``df`` with the columns mix_source, mix_start (place of the row in its source, in units of
    ``size``), mix_block, mix_slot, mix_release and mix_deadline. (mix_slot, mix_start,
    mix_source) is the order of the mixture.
    """
    if len(weights) > MAX_SOURCES or sum(weights.values()) + other > MAX_PERIOD or other < 1 \
            or any(w < 1 for w in weights.values()):
        raise ValueError(f"weights are positive integers of at most {MAX_SOURCES} sources and a sum of {MAX_PERIOD}")
    spark = df.sparkSession
    rest = "*"
    while rest in weights:
        rest += "*"
    share = weights | {rest: other}
    name = {c: fresh(df, c) for c in ("mix_source", "mix_start", "mix_block", "mix_slot", "mix_release",
                                      "mix_deadline", "mix_size", "mix_bucket", "mix_key", "mix_s", "mix_b",
                                      "mix_before", "mix_b0", "mix_b1", "mix_at", "mix_first", "mix_period")}
    col = lambda c: F.col(name[c])
    size = F.length("text") if size is None else size
    src = F.when(F.col(f"`{source}`").isin(list(weights)), F.col(f"`{source}`")).otherwise(F.lit(rest))
    hashed = [F.col(f"`{f.name}`") for f in df.schema if f.name != id_col and isinstance(f.dataType, T.AtomicType)]
    rows = df.withColumns({name["mix_source"]: src, name["mix_size"]: F.coalesce(size.cast("long"), F.lit(0)),
                           name["mix_key"]: F.xxhash64(f"`{id_col}`", *hashed)})
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy(name["mix_source"]).agg(
        F.count("*"), F.sum(name["mix_size"])).collect()}       # a row for each name in ``share``
    count = {s: n // BUCKET_ROWS + 1 for s, (n, _) in totals.items()} or {rest: 1}
    blocks = {s: max(total - 1, 0) // block + 1 for s, (_, total) in totals.items()}
    spread = F.create_map(*[x for s, n in count.items() for x in (F.lit(s), F.lit(n))])
    rows = rows.withColumn(name["mix_bucket"], F.pmod(col("mix_key"), spread[col("mix_source")]))
    per = rows.groupBy(name["mix_source"], name["mix_bucket"]).agg(F.sum(name["mix_size"]).alias("total"))
    per = running(per, [name["mix_source"]], name["mix_bucket"], "total", name["mix_before"]).select(
        col("mix_source").alias(name["mix_s"]), col("mix_bucket").alias(name["mix_b"]), col("mix_before"))
    inside = Window.partitionBy(name["mix_source"], name["mix_bucket"]).orderBy(name["mix_key"], f"`{id_col}`") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(name["mix_start"], F.sum(name["mix_size"]).over(inside) - col("mix_size"))
    rows = rows.join(per, (col("mix_source") == col("mix_s")) & (col("mix_bucket") == col("mix_b"))) \
        .withColumn(name["mix_start"], col("mix_start") + col("mix_before")).drop(*[name[c] for c in ("mix_s", "mix_b")])
    rows = rows.withColumn(name["mix_block"], F.least(
        F.floor(col("mix_start") / block), F.create_map(
            *[x for s, n in (blocks or {rest: 1}).items() for x in (F.lit(s), F.lit(n - 1))])[col("mix_source")]))
    plan = phases(share, blocks)
    flat = [(s, b0, steps[i + 1][0] if i + 1 < len(steps) else None, slot, p, at)
            for s, steps in plan.items() for i, (b0, slot, p, at) in enumerate(steps)]
    table = F.broadcast(spark.createDataFrame(  # at most one row for each source and phase
        flat, f"`{name['mix_s']}` string, `{name['mix_b0']}` bigint, `{name['mix_b1']}` bigint, "
              f"`{name['mix_first']}` bigint, `{name['mix_period']}` int, `{name['mix_at']}` array<int>"))
    k = col("mix_block")
    rows = rows.join(table, (col("mix_source") == col("mix_s")) & (k >= col("mix_b0"))
                     & (col("mix_b1").isNull() | (k < col("mix_b1"))))
    at, e, i, p, zero = col("mix_at"), F.size(col("mix_at")), k - col("mix_b0"), col("mix_period"), col("mix_first")
    out = rows.withColumns({
        name["mix_slot"]: zero + F.floor(i / e) * p + F.get(at, (i % e).cast("int")),
        name["mix_release"]: zero + F.floor(i * p / e),
        name["mix_deadline"]: zero + F.ceil((i + 1) * p / e)})
    new = ("mix_source", "mix_start", "mix_block", "mix_slot", "mix_release", "mix_deadline")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[col(c) for c in new])


def mixed(df: DataFrame, weights: dict[str, int], other: int = 1, source: str = "source",
          block: int = 65_536, id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``df``, laid out in the order of the mixture: written as it is,
    the files one after another hold the blocks slot by slot."""
    new = [fresh(df, c) for c in ("mix_slot", "mix_start", "mix_source")]
    got = mix(df, weights, other, source, F.length("text"), block, id_col)
    return got.repartitionByRange(*new).sortWithinPartitions(*new).select(*[F.col(f"`{c}`") for c in df.columns])
