"""CSV records over split files against Python's csv module, with cells that cross every border."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.sources import records as R
from quarry.sources.io import read_csv, write_csv

SMALL = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cell(rnd):
    return "".join(rnd.choice(['a', 'é', '"', '""', ',', '\n', '\n\n', ' ', 'long text ' * 3, ';', "'", '\\', '']) for _ in range(rnd.randint(0, 6)))


def write(path, rows, end="\n", sep=","):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end, delimiter=sep).writerows(rows)


def got_of(spark, path, **kw):
    return sorted(tuple("" if c is None else c for c in r) for r in read_csv(spark, str(path), (), infer=False, **kw).collect())


@pytest.mark.parametrize("end,sep,seed", [("\n", ",", 1), ("\r\n", ",", 2), ("\n", ";", 3)])
def test_split_files_give_the_records_of_whole_ones(spark, tiny_splits, tmp_path, end, sep, seed):
    rnd = random.Random(seed)
    want = []
    for k in range(2):
        rows = [(f"k{k}-{i}", cell(rnd), cell(rnd)) for i in range(30)]
        rows.append((f"k{k}-huge", "line of a cell\n" * 100, 'x"y'))
        write(tmp_path / f"f{k}.csv", [("id", "a text", "b\nname"), *rows], end, sep)
        want += rows
    lines = R.lines_of(spark, str(tmp_path), sep)
    assert lines.select("file", "block").distinct().count() > 12 and R.ranges(lines).where("inside").count() > 4
    kw = {"sep": sep} if sep != "," else {}
    assert got_of(spark, tmp_path, **kw) == sorted(want)
    assert read_csv(spark, str(tmp_path), infer=False, **kw).columns == ["id", "a text", "b\nname"]


def test_many_ranges_meet_by_shuffle(spark, tiny_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_RANGES", 3)
    rnd = random.Random(9)
    rows = [(str(i), cell(rnd)) for i in range(40)]
    write(tmp_path / "f.csv", [("i", "t"), *rows])
    assert got_of(spark, tmp_path) == sorted(rows)


def test_header_across_ranges_blank_lines_and_open_quote(spark, tiny_splits, tmp_path):
    name = "a very long name\n" * 20
    (tmp_path / "f.csv").write_text(f'"{name}",b\n\n1,2\n\n\n"3","4"\n5,"never closed\nmore')
    got = read_csv(spark, str(tmp_path / "f.csv"), infer=False)
    assert got.columns == [name, "b"]
    assert sorted(map(tuple, got.collect())) == [("1", "2"), ("3", "4"), ("5", "never closed\nmore")]
    (tmp_path / "g.csv").write_text("x,y\n")
    assert read_csv(spark, str(tmp_path / "g.csv"), infer=False).count() == 0


def test_stray_quotes_open_nothing(spark, tiny_splits, tmp_path):
    (tmp_path / "f.csv").write_text('size,n\n5" pipe,1\na"b"c,2\n6",3\n"x\ny",4\n')
    got = sorted(map(tuple, read_csv(spark, str(tmp_path / "f.csv"), infer=False).collect()), key=lambda r: r[1])
    assert got == [('5" pipe', "1"), ('a"b"c', "2"), ('6"', "3"), ("x\ny", "4")]


def test_one_large_file_is_many_tasks(spark, tmp_path):
    df = spark.range(40_000).select("id", F.concat(F.lit('say "hi",\nto '), F.col("id").cast("string"), F.lit("\n")).alias("t"))
    write_csv(df.coalesce(1), str(tmp_path / "x"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    try:
        got = read_csv(spark, str(tmp_path / "x"))
        tasks = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(tasks) > 5 and max(r["count"] for r in tasks) < 10_000
        assert got.exceptAll(df).count() == 0 and got.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from('a",\n é'), max_size=8), min_size=2, max_size=2), min_size=1, max_size=12))
def test_steps_join_lines_as_csv_does(spark, rows):
    """The fold over the lines' steps ends outside exactly behind each record."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    lines = out.getvalue().split("\n")[:-1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").coalesce(1)
    steps = [r.s for r in df.select("i", R.line_steps(F.col("line")).alias("s")).orderBy("i").collect()]
    inside, joined, part = False, [], []
    for x, s in zip(lines, steps):
        inside = (inside, not inside, False, True)[s]
        part.append(x)
        if not inside:
            joined.append("\n".join(part))
            part = []
    assert not part and [next(csv.reader(io.StringIO(j, newline=""))) for j in joined] == rows
