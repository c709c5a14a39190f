"""Rolling means over time: frames of any width, by rows of the largest task, against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import windows as W

ZERO = dt.datetime(2024, 1, 1)


def brute(rows, seconds, least):
    out = []
    for g, t, v in rows:
        if t is None:
            out.append((g, t, v, None))
            continue
        x = [b for h, u, b in rows if h == g and u is not None and t - dt.timedelta(seconds=seconds) < u <= t
             and b is not None and not math.isnan(b)]
        v = None if v is None or math.isnan(v) else v
        out.append((g, t, v, sum(x) / len(x) if len(x) >= max(least, 1) else None))
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r[:3])


@pytest.mark.parametrize("seconds,least,block", [(90, 1, 4), (3600, 3, 3), (10**7, 1, 2), (1, 1, 256), (600, 5, 1)])
def test_frames_over_many_blocks(spark, seconds, least, block):
    rnd = random.Random(seconds)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), ZERO + dt.timedelta(seconds=rnd.randint(0, 4000)),
             rnd.choice([None, float("nan"), -5.5, 1e12, *[rnd.random() for _ in range(6)]])) for _ in range(300)]
    rows += [("a", None, 1.0), ("b", ZERO, 2.0), ("b", ZERO, 4.0), ("c", ZERO, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, ts timestamp, v double, t int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = W.rolling_mean_time(df, "v", "ts", seconds, ["g"], least, "m", block=block).drop("t").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for a, z in zip(sorted(got, key=key), sorted(brute(rows, seconds, least), key=key)):
        assert key(a) == key(z) and (a.m is None) == (z[3] is None)
        assert a.m is None or math.isclose(a.m, z[3], rel_tol=1e-9, abs_tol=1e-12)


def test_sums_are_no_differences_of_larger_ones(spark):
    """Huge values outside a frame leave no trace in its mean."""
    rows = [(ZERO + dt.timedelta(seconds=i), 1e300 if i < 100 else float("inf") if i == 100 else 1.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    got = {r.ts: r.m for r in W.rolling_mean_time(df, "v", "ts", 200, name="m", block=8).collect()}
    assert all(got[ZERO + dt.timedelta(seconds=i)] == 1.5 for i in range(301, 1000))
    assert got[ZERO + dt.timedelta(seconds=200)] == float("inf")


def test_one_frame_over_everything_is_many_tasks(spark):
    df = spark.range(40_000).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("v"))
    for k, v in {"coalescePartitions.enabled": "false"}.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        cells = df.select(F.unix_micros("ts").alias("t"), F.col("v").alias("total"), F.lit(1).cast("bigint").alias("n"))
        f = W._frames(cells, [], 30 * 86_400 * 1_000_000)
        assert f.agg(F.max("lo"), F.min("i"), F.max("i")).first()[:] == (0, 0, 39_999)
        out = W.rolling_mean_time(df, "v", "ts", 30 * 86_400, name="m")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange SinglePartition" not in plan
        blocks = f.groupBy(F.floor(F.col("i") / 256)).count().agg(F.max("count")).first()[0]
        assert blocks == 256
        last = out.orderBy(F.desc("ts")).first().m
        assert math.isclose(last, sum(i % 7 for i in range(40_000)) / 40_000, rel_tol=1e-12)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
