"""Radix selection: order of the digits, spikes of distinct values, hot values, extremes, several levels."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.quantiles import ordered_bits, quantiles_long

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"),
         float("-inf"), 1.0, math.nextafter(1, 0), math.nextafter(1, 2), -1.0, 0.1, 8.0, math.nextafter(8, 0), 1e300, -1e-300,
         *[2.0 ** e for e in range(-1074, 1024, 37)], *[math.nextafter(2.0 ** e, 0) for e in range(-1000, 1024, 61)]]


def bits_of(x):
    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=300))
def test_bits_order_like_the_numbers(spark, xs):
    xs = xs + EDGES
    got = spark.createDataFrame([(x,) for x in xs], "v double").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [bits_of(x) for x in xs]


def brute(values, p):
    a = np.sort(np.asarray(values))
    pos = p * (len(a) - 1)
    lo, hi = a[int(math.floor(pos))], a[int(math.ceil(pos))]
    return lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))


PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy,buckets", [(1, 1024), (5, 16), (10000, 1024)])
def test_spikes_and_hot_values(spark, accuracy, buckets):
    gen = np.random.default_rng(2)
    spike = np.unique(1000 + np.arange(4000) * np.spacing(1000.0))          # neighbouring doubles
    groups = {
        "spike": np.concatenate([spike, gen.normal(0, 1e6, 500)]),
        "hot": np.concatenate([np.full(3000, 0.1), gen.random(1000), [-0.0] * 5]),
        "wide": np.concatenate([10.0 ** gen.uniform(-300, 300, 800), -(10.0 ** gen.uniform(-300, 300, 700))]),
        "one": np.array([7.5]), "two": np.array([-1.0, 2.0]), "inf": np.array([float("-inf"), 1.0, 2.0, float("inf")])}
    rows = [(g, float(x)) for g, a in groups.items() for x in a] + [("hot", None), ("hot", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "`g k` string, v double").repartition(4)
    got = {(r["g k"], r.p): r.q for r in quantiles_long(df, ["g k"], "v", PS, accuracy, buckets).collect()}
    want = {(g, p): brute(a, p) for g, a in groups.items() for p in PS}
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == x or math.isnan(got[k]) and math.isnan(x) or math.isclose(got[k], x, rel_tol=1e-14), k


def test_spike_is_cut_into_small_buckets(spark):
    """A column whose values all lie in a millionth of its range: no bucket of the last level is large."""
    df = spark.range(50_000).select(F.lit(1).alias("g"), (1.0 + F.col("id") * 1e-12).alias("v")) \
        .union(spark.range(10).select(F.lit(1), F.col("id") * 1e9))
    got = {r.p: r.q for r in quantiles_long(df, ["g"], "v", [0.1, 0.5], accuracy=5).collect()}
    a = np.sort(np.concatenate([1.0 + np.arange(50_000) * 1e-12, np.arange(10) * 1e9]))
    assert got == {p: pytest.approx(np.quantile(a, p), rel=1e-15) for p in (0.1, 0.5)}


def test_no_rows(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert quantiles_long(df, ["g"], "v", [0.5]).count() == 0 and quantiles_long(df, [], "v", [0.5]).count() == 0
