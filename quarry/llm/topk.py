"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; of each, mean and deviation are kept, at several resolutions. For
a query q and a vector x the squared distance is at least

    sum over segments of m ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),   m the segment's length,

so the inner product (|q|^2 + |x|^2 - d^2) / 2 is at most sum of m (mean_q mean_x + dev_q dev_x).
Pairs whose bound falls below the query's k-th best so far go, coarse segments first; the rest
get exact integer scores.

Queries and vectors are dealt into blocks by a hash of their row number; each pair of a query block and a
vector block is one cell, worked on in slices of bounded size. The first vector block, a random
part of all, gives every query a k-th best to start from.

Defined cases: vectors that are null or hold a null or non-finite component take no part, and
rows without an id neither; every other row is a candidate for each query of another id, also if
its id or its vector is repeated, and rows of a repeated query id are ranked together; vectors are
compared with those of their own length (empty ones score 0 among themselves); ties go to the
smaller id; an empty table gives an empty result; scores must fit in 64 bits; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

QUERY_BLOCK, VECTOR_BLOCK = 2048, 16_384
SLICE = 2048
RESOLUTIONS = (1, 4, 16)


def scaled(df: DataFrame, id_col: str, vec: str, scale: int) -> DataFrame:
    """id, v: floor(scale * component) as long."""
    v = F.col(f"`{vec}`")
    good = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).where(F.coalesce(good, F.lit(False)))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col(f"`{id_col}`").alias("id"), ints.alias("v"))


def _statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """sqrt(m) mean and sqrt(m) deviation of each segment, side by side."""
    if not x.shape[1]:
        return np.zeros((len(x), 1))
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    m = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return np.hstack([total / np.sqrt(m), np.sqrt(np.maximum(square - total * total / m, 0))])


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs."""
    out = np.empty(len(i), np.int64)
    size = max(1, 4_000_000 // max(q.shape[1], 1))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2 ** 62
    for a in range(0, len(i), size):
        l, r = q[i[a:a + size]], x[j[a:a + size]]
        if exact:
            out[a:a + size] = (l * r).sum(axis=1)
        else:
            out[a:a + size] = (l.astype(object) * r.astype(object)).sum(axis=1)
    return out


def search_cell(qid, q, floor, xid, x, k: int):
    """(query id, vector id, score) rows that hold each query's k best of these vectors.

    ``floor`` is a score that each query's k-th best is known to reach; lower scores go.
    """
    qf, best = q.astype(float), floor.astype(float).copy()
    levels = [(_statistics(qf, r), r) for r in RESOLUTIONS]
    found = []
    for at in range(0, len(x), SLICE):
        part, ids = x[at:at + SLICE], xid[at:at + SLICE]
        pf = part.astype(float)
        slack = 1e-9 * (np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(pf, axis=1)[None, :]) + 1e-6
        alive = qid[:, None] != ids[None, :]
        for stats, r in levels:
            if r == RESOLUTIONS[0]:
                alive &= stats @ _statistics(pf, r).T + slack >= best[:, None]
            else:
                cols = np.flatnonzero(alive.any(axis=0))
                if len(cols):
                    alive[:, cols] &= stats @ _statistics(pf[cols], r).T + slack[:, cols] >= best[:, None]
        i, j = np.nonzero(alive)
        s = _scores(q, part, i, j)
        ok = s >= best[i]
        rows = pd.DataFrame({"q": i[ok], "id": ids[j[ok]], "s": s[ok]})
        found.append(rows)
        both = pd.concat(found).sort_values(["q", "s", "id"], ascending=[True, False, True], kind="stable")
        both = both[both.groupby("q").cumcount() < k]
        found = [both]
        last = both.groupby("q")["s"].agg(["min", "size"])
        full = last.index[last["size"] >= k].to_numpy()
        best[full] = np.maximum(best[full], last.loc[full, "min"].to_numpy())
    both = found[0] if found else pd.DataFrame({"q": [], "id": [], "s": []})
    return qid[both["q"].to_numpy(dtype=int)], both["id"].to_numpy(np.int64), both["s"].to_numpy(np.int64)


def _cells(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score) of all cells; both sides hold dim, qb, cb, id, v."""
    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        left, right = left.sort_values("id"), right.sort_values("x_id")
        q, x = np.stack(left["v"].to_list()), np.stack(right["x_v"].to_list())
        a, b, s = search_cell(left["id"].to_numpy(np.int64), q, left["low"].to_numpy(np.float64),
                              right["x_id"].to_numpy(np.int64), x, k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    keys = ("dim", "qb", "cb")
    other = vectors.select(*[F.col(c).alias(f"x_{c}") for c in (*keys, "id", "v")])
    return queries.groupBy(*keys).cogroup(other.groupBy(*[f"x_{c}" for c in keys])).applyInPandas(
        work, "query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec: str = "embedding", k: int = 10,
          scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest inner products with other rows.

    ``is_query`` maps the id column to a condition.
    """
    # Rows are dealt by their number, so that a repeated id spreads over the blocks.
    rows = stored(scaled(df, id_col, vec, scale).withColumns(
        {"dim": F.size("v"), "n": F.monotonically_increasing_id()}), "vectors")
    ask = rows.where(is_query(F.col("id")))
    h = F.xxhash64("n")
    nq, nx = ask.count() // QUERY_BLOCK + 1, rows.count() // VECTOR_BLOCK + 1
    queries = ask.withColumn("qb", F.pmod(h, F.lit(nq)).cast("int"))
    vectors = rows.withColumn("cb", F.pmod(F.shiftright(h, 8), F.lit(nx)).cast("int")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    none = F.lit(float("-inf"))
    start = _cells(queries.withColumn("cb", F.lit(0)).withColumn("low", none), vectors.where("cb = 0"), k)
    start = stored(start, "start")
    low = start.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")) \
        .where(F.col("c") >= k).select(F.col("query_id").alias("id"), F.col("s").cast("double").alias("known"))
    rest = queries.join(low, "id", "left").withColumn("low", F.coalesce("known", none)).drop("known") \
        .withColumn("cb", F.explode(F.sequence(F.lit(1), F.lit(nx - 1)))) if nx > 1 else None
    got = start if rest is None else start.unionByName(_cells(rest, vectors.where("cb > 0"), k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
