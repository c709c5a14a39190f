"""Ordered operators by slices of the key: no copy of the table, one shuffle of its rows."""

import glob
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import windows as W
from quarry.session import checkpoint_dir


def exchanges(df):
    """Inputs of the plan's shuffles, as text."""
    said = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.search(r"Input \[\d+\]: \[.*\]", x)[0] for x in said.split("\n\n")
            if re.search(r"^\(\d+\) Exchange", x.strip())]


def stored(spark):
    root = checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/**/part-*", recursive=True))


@pytest.fixture(scope="module")
def frame(spark):
    """Missing and repeated keys, one hot group, text of some length."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"i": np.arange(n), "g": rng.choice(["a", "b", None], n, p=[0.8, 0.1, 0.1]),
                        "k": rng.integers(0, 40, n), "v": rng.normal(size=n).round(3)})
    rows = [(int(i), g, None if k == 0 else int(k), None if i % 3 else float(v))
            for i, g, k, v in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "i long, g string, k int, v double").repartition(5)
    return rows, df.withColumn("text", F.repeat(F.col("i").cast("string"), 200))


def order(r):
    return (r[2] is not None, r[2] or 0, r[0])


def test_index_and_fill_against_python(frame):
    rows, df = frame
    rank, last, want = {}, {}, {}
    for r in sorted(rows, key=order):
        rank[r[1]] = rank.get(r[1], -1) + 1
        last[r[1]] = r[3] if r[3] is not None else last.get(r[1])
        want[r[0]] = (rank[r[1]], last[r[1]])
    index = {r["i"]: r["at"] for r in W.ordered_index(df, ["k", "i"], ["g"], "at").collect()}
    filled = {r["i"]: r["v"] for r in W.forward_fill(df, "v", ["k", "i"], ["g"]).collect()}
    assert {i: (index[i], filled[i]) for i in index} == want


def test_no_copy_and_one_exchange_of_the_rows(frame, spark):
    _, df = frame
    df = df.coalesce(5)
    before = stored(spark)
    for out in (W.ordered_index(df, ["k", "i"], ["g"]), W.forward_fill(df, "v", ["k", "i"], ["g"])):
        assert sum("text#" in x for x in exchanges(out)) == 1
        assert out.count() == 6000
    assert stored(spark) - before < 100_000       # borders only; the texts are 3 MB


def test_slices_are_even_and_ordered(frame):
    _, df = frame
    s = W._with_slices(df, ["g", "k", "i"], "pid").groupBy("pid").agg(
        F.count("*").alias("n"), F.min(F.struct("g", "k", "i")).alias("lo"), F.max(F.struct("g", "k", "i")).alias("hi"))
    got = s.orderBy("pid").collect()
    assert len(got) == 8 and max(r["n"] for r in got) < 2 * 6000 / 8     # the hot group is cut
    key = lambda t: tuple((x is not None, x) if x is not None else (False,) for x in t)
    assert all(key(a["hi"]) < key(b["lo"]) for a, b in zip(got, got[1:]))


def test_ties_follow_the_same_order_in_every_pass(spark):
    rows = [(i % 3, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    a = {(r["k"], r["v"]): r["row_index"] for r in W.ordered_index(df, ["k"]).collect()}
    b = {(r["k"], r["v"]): r["row_index"] for r in W.ordered_index(df.repartition(3), ["k"]).collect()}
    assert a == b and sorted(a.values()) == list(range(300))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert W.ordered_index(empty, ["k"]).count() == 0 and W.forward_fill(empty, "v", ["k"]).count() == 0
    one = spark.createDataFrame([(None, 1.0, 5, {"a": 1}), (float("nan"), None, 6, {}), (2.0, None, 7, None)],
                                "`a.b` double, v double, _pid int, _cuts map<string,int>")
    out = W.forward_fill(one, "v", ["a.b"]).orderBy("_pid").collect()
    assert [r["v"] for r in out] == [1.0, 1.0, 1.0]
    assert [r["row_index"] for r in W.ordered_index(one, ["a.b"]).orderBy("_pid").collect()] == [0, 2, 1]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(r["row_index"] for r in W.ordered_index(one, ["a.b"]).collect()) == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
