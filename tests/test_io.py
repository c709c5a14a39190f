"""CSV reading with missing-value tokens and type inference; writers round-trip."""

import os
import tempfile

from quarry.sources import io as IO


def test_read_csv_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="quarry-io-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d,e\n1,x,2024-01-01,true,1.5\nNA,,2024-02-03,false,NA\n3,y,n/a,TRUE,2\n")
    df = IO.read_csv(spark, path)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "string", "c": "timestamp", "d": "boolean", "e": "double"}
    rows = df.orderBy("b").collect()
    assert [r["a"] for r in rows] == [None, 1, 3]
    assert rows[0]["b"] is None and rows[0]["e"] is None
    raw = IO.read_csv(spark, path, infer=False)
    assert all(t == "string" for _, t in raw.dtypes)


def test_report_and_json_roundtrip(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b"), (2, None, "b")],
                               "k long, v double, s string")
    d = tempfile.mkdtemp(prefix="quarry-io-")
    out = IO.write_report(df, d)
    q = {r["column"]: r for r in spark.read.parquet(out["quality"]).collect()}
    assert q["v"]["missing_pct"] == 66.7 and q["s"]["unique"] == 2
    stats = {r["column"]: r for r in spark.read.parquet(out["statistics"]).collect()}
    assert stats["k"]["mean"] == 1.667
    IO.write_json(df, d + "/json")
    assert IO.read_json(spark, d + "/json").count() == 3
    frames = IO.report_frames(df, 2, ["k"])
    assert frames["preview"].count() == 2 and frames["meta"].first()["rows"] == 3
