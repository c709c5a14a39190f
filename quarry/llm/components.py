"""Connected components of an undirected edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): comp is the same for all nodes that edges (a, b) connect.

    Each round every node points to its smallest neighbour or itself, pointers are shortened
    twice, and edges are redrawn between what they point to; edges inside one pointer go. Hot
    nodes meet only in minima, which Spark takes before it shuffles.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
               .where(F.col("a") != F.col("b")).distinct(), "edges")
    label = e.sparkSession.createDataFrame([], "id bigint, comp bigint")
    first = True
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")) \
            .select("id", F.least("id", "m").alias("up"))
        up = stored(up, "up")
        for _ in range(2):
            hop = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
            up = stored(up.join(hop, "up").select("id", F.col("next").alias("up")), "up")
        if first:
            label, first = up.withColumnRenamed("up", "comp"), False
        else:
            nxt = up.select(F.col("id").alias("comp"), "up")
            label = stored(label.join(nxt, "comp", "left")
                           .select("id", F.coalesce("up", "comp").alias("comp")), "label")
        to = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"u{c}"))
        e = stored(e.join(to("a"), "a").join(to("b"), "b")
                   .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
                   .where(F.col("a") != F.col("b")).distinct(), "edges")
    return label
