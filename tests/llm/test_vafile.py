"""Clusters over the VA-file against plain Python, and its bounds against exact distances."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import vafile


def brute(rows, dim, k, rounds, seed=3):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cent = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in got)
    return [(i, c, d, sum(e for _, b, e in got if b == c), total,
             hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, c, d in got]


def vectors(dim):
    gen = np.random.default_rng(5)
    middle = gen.normal(size=(5, dim))
    rows = [(i, (middle[i % 5] + gen.normal(scale=0.3 + i % 3, size=dim)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]                      # copies
    rows += [(7, rows[1][1]), (7, rows[2][1]), (7, rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1)),
             (904, [float("nan")] + [1.0] * (dim - 1)), (905, [float("-inf")] * dim)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, id int, v int").repartition(3)
    out = vafile.cluster(df, **kw)
    assert out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("dim,k,rounds,bits", [(64, 8, 10, 4), (7, 5, 3, 2), (3, 4, 0, 8), (2, 3, 6, 1)])
def test_clusters(spark, monkeypatch, dim, k, rounds, bits):
    monkeypatch.setattr(vafile, "BLOCK", 70)
    monkeypatch.setattr(vafile, "GAP", 2)
    rows, log = vectors(dim), []
    got = run(spark, rows, dim=dim, k=k, rounds=rounds, bits=bits, log=log)
    assert got == sorted(brute(rows, dim, k, rounds), key=repr)
    assert log[0] == len(got) and all(n <= len(got) for n in log)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 4), (2, [0.5] * 4), (None, [9.0] * 4)]
    assert run(spark, rows, dim=4) == sorted(brute(rows, 4, 8, 10), key=repr)
    assert run(spark, [(1, None), (2, [1.0])], dim=4) == []
    assert run(spark, [], dim=4) == []


def test_far_components_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1e9, 1.0]), (2, [0.0, 0.0])], dim=2)


def test_apart_clusters_need_few_vectors(spark):
    gen = np.random.default_rng(1)
    rows = [(i, (np.eye(16)[i % 4] * 50 + gen.normal(scale=0.5, size=16)).tolist()) for i in range(800)]
    log = []
    got = run(spark, rows, dim=16, k=4, rounds=10, log=log)
    assert got == sorted(brute(rows, 16, 4, 10), key=repr)
    assert sum(log[1:]) < len(rows) * (len(log) - 1) / 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 4, 8]), st.integers(1, 9))
def test_bounds_hold(seed, bits, dim):
    gen = np.random.default_rng(seed)
    x, c = gen.integers(-50, 50, (40, dim)), gen.integers(-60, 60, (5, dim))
    cuts = np.sort(gen.integers(-50, 50, (dim, 2 ** bits - 1)), axis=1)
    ends = np.stack([np.column_stack([x.min(axis=0), cuts]), np.column_stack([cuts - 1, x.max(axis=0)])], axis=1)
    ends[:, 0, 0] = np.minimum(x.min(axis=0), cuts[:, 0])
    ends[:, 1] = np.maximum(ends[:, 1], ends[:, 0])
    least, most = vafile.bounds(vafile.pack_cells(x, cuts, bits), vafile.lookup(ends, c, bits))
    d = vafile.distances(x, c)
    assert (least <= d).all() and (d <= most).all()
    best, open_ = vafile.decide(least, most)
    assert (best == np.argmin(d, axis=1))[~open_].all()
