"""URL filters: a temporal join of captures and dated list entries.

Entries add or remove a host pattern on a list at a time. Per pattern and list, consecutive
entries become validity intervals; a capture is judged by the entries that were active when it
was fetched: of the patterns that cover its host, the longest, and of its lists "block" before
"allow".

A verdict depends on host and fetch time alone, so captures are first reduced to distinct pairs
(aggregated before the shuffle: a hot host costs one row for each time); verdicts are joined
back on small rows.

Hosts and patterns are compared in lower case and without a final dot; an IP address is covered by
itself alone.

Defined cases: URLs without a host, null URLs and null times have the verdict "none"; entries
with a null field are left out; of entries at one time "remove" counts; repeated rows are judged
each; an empty table gives an empty result; clashing columns of the captures are kept, the new
ones are named by ``prefix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def plain_host(host: Column) -> Column:
    """Lower case, without blanks around and the root's final dot."""
    return F.regexp_replace(F.lower(F.trim(host)), r"[.]$", "")


def host_of(url: Column) -> Column:
    return plain_host(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def covering(host: Column) -> Column:
    """The host and its parent domains of two labels or more; an IP address has no parents."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.regexp_like(host, F.lit(r"^[0-9]+([.][0-9]+){3}$")), F.array(host)).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, start, end) of entries (pattern, action, op, at); end is null if open."""
    good = entries.dropna(subset=["pattern", "action", "op", "at"]).withColumn("pattern", plain_host(F.col("pattern")))
    last = good.groupBy("pattern", "action", "at").agg(F.max(F.col("op") == "remove").alias("gone"))
    w = Window.partitionBy("pattern", "action").orderBy("at")
    return last.withColumn("end", F.lead("at").over(w)).where(~F.col("gone")) \
        .select("pattern", "action", F.col("at").alias("start"), "end")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "at", prefix: str = "list_") -> DataFrame:
    """``captures`` with host, pattern, verdict and number of active entries."""
    new = {c: fresh(captures, prefix + c) for c in ("host", "pattern", "verdict", "active", "h", "a")}
    rows = captures.withColumn(new["host"], host_of(F.col(f"`{url}`")))
    pairs = rows.select(F.col(new["host"]).alias("host"), F.col(f"`{at}`").alias("at")) \
        .where((F.col("host") != "") & F.col("at").isNotNull()).distinct()
    keys = pairs.withColumn("pattern", F.explode(covering(F.col("host"))))
    span = intervals(entries).withColumnRenamed("pattern", "p")
    hit = keys.join(span, (F.col("pattern") == F.col("p")) & (F.col("at") >= F.col("start"))
                    & (F.col("end").isNull() | (F.col("at") < F.col("end"))))
    best = hit.groupBy("host", "at").agg(
        F.max(F.struct(F.length("pattern").alias("n"), (F.col("action") == "block").alias("b"), "pattern", "action")).alias("m"),
        F.count("*").alias("c")).select(
        F.col("host").alias(new["h"]), F.col("at").alias(new["a"]), F.col("m.pattern").alias(new["pattern"]),
        F.col("m.action").alias(new["verdict"]), F.col("c").alias(new["active"]))
    out = rows.join(best, (rows[new["host"]] == best[new["h"]]) & (rows[at] == best[new["a"]]), "left").drop(new["h"], new["a"])
    return out.withColumns({new["verdict"]: F.coalesce(new["verdict"], F.lit("none")),
                            new["active"]: F.coalesce(new["active"], F.lit(0))})
