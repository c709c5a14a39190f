"""The robust estimates against a NumPy restatement, and texts that each statistic alone rejects."""

import math
import random

import numpy as np
import pytest

from quarry.llm import quality
from quarry.llm.quality import FLOOR, PRIOR, PRIOR_TEXTS, SCALE, STEPS, SUPPORT, TAIL

SCHEMA = "doc_id bigint, text string, lang string, source string"
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def repeated(n, share):
    """n words, of which ``share`` stand in a passage that is there twice."""
    w = prose(n).split()
    k = int(n * share / 2)
    w[n // 2:n // 2 + k] = w[:k]
    return " ".join(w)


def lined(lines, same):
    out = [prose(8) for _ in range(lines - same)]
    return "\n".join(out + [out[0]] * same)


def median(x):
    return float(np.median(x))


def estimate(x):
    """(mean, covariance) of the rows of x that the concentration steps end with."""
    c = lambda d: (d.mean(axis=0), d.T @ d / len(d) - np.outer(d.mean(axis=0), d.mean(axis=0)))
    floor = [f * SCALE for f in FLOOR]
    m = np.array([median(x[:, i]) for i in range(4)])
    mad = np.array([(1.4826 * median(abs(x[:, i] - m[i]))) ** 2 for i in range(4)])
    q = quality._chi2_quantile(SUPPORT, 4)
    factor = SUPPORT / quality._chi2_cdf(q, 6)
    best = None
    for start in ((m, np.diag(mad)), c(x)):
        for _ in range(STEPS):
            d2, _ = distance(x, *start, floor)
            b = np.floor(np.log2(np.maximum(d2, 1e-6)) * 64)
            cut = np.sort(b)[math.ceil(SUPPORT * len(x)) - 1]
            mean, cov = c(x[b <= cut])
            start = (mean, cov * factor)
        det = distance(x, *start, floor)[1]
        if best is None or det < best[0]:
            best = (det, start)
    return best[1]


def distance(x, m, c, floor):
    l = np.zeros((4, 4))
    for j in range(4):
        for i in range(j, 4):
            v = c[i, j] - l[i, :j] @ l[j, :j]
            l[i, j] = math.sqrt(max(v, floor[i] ** 2)) if i == j else v / l[j, j]
    z = np.linalg.solve(l, (x - m).T)
    return (z * z).sum(axis=0), np.log(np.diag(l)).sum()


def restated(rows):
    """doc_id -> (distance, kept) of the statistics rows that pass the base rules."""
    x, group = {}, {}
    for r in rows:
        n, c = r.n_words, r.word_chars
        v = (math.log((c + 5 * PRIOR) / (n + PRIOR)), math.sqrt(r.n_symbols / (c + 5 * PRIOR)),
             r.n_dup_lines / (r.n_lines + 10), r.n_repeat_words / (n + PRIOR))
        x[r.doc_id] = [math.floor(abs(a) * SCALE + 0.5) * (1 if a >= 0 else -1) for a in v]
        for g in ((r.lang, r.source), (r.lang,), ()):
            group.setdefault(g, []).append(r.doc_id)
    at = lambda ids: np.array([x[i] for i in ids], float)
    est = {g: (estimate(at(ids)), len(ids)) for g, ids in group.items()}
    out = {}
    for g, ids in group.items():
        if len(g) == 2:
            m, c = est[()][0]
            for level in (g[:1], g):
                (m1, c1), n = est[level]
                w = n / (n + PRIOR_TEXTS)
                m, c = w * m1 + (1 - w) * m, w * c1 + (1 - w) * c
            d2, _ = distance(at(ids), m, c, [f * SCALE for f in FLOOR])
            limit = quality._chi2_quantile(1 - TAIL, 4)
            out |= {i: (math.sqrt(d), d <= limit) for i, d in zip(ids, d2)}
    return out


def judged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: r for r in quality.judge(df).collect()}


def test_kept_equals_a_restatement(spark):
    rows = []
    for i in range(420):
        lang = rnd.choice(["en", "en", "en", "fr", None])
        text = prose(rnd.randint(12, 300)) if i % 9 else rnd.choice(
            [repeated(200, 0.15), lined(12, 3), " ".join(w + "#" for w in prose(60).split()), prose(40).replace(" ", "")
             + " " + prose(12), " | ".join(prose(9) for _ in range(20))])
        rows.append((i, text, lang, f"s{rnd.randrange(3)}" if i % 5 else "big"))
    rows.append((1000, prose(90), "one of its language", "lone"))
    df = spark.createDataFrame(rows, SCHEMA)
    stats = [r for r in quality.statistics(df).collect()
             if r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words]
    want, got = restated(stats), judged(spark, rows)
    assert {i for i, r in got.items() if not r.base_failed} == set(want)
    for i, (d, kept) in want.items():
        assert got[i].kept == kept and got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-6)
    assert {k for _, k in want.values()} == {True, False}


@pytest.mark.parametrize("bad", [
    lambda: repeated(400, 0.19), lambda: lined(40, 12), lambda: " ".join(w + "###%" for w in prose(100).split()),
    lambda: " ".join(prose(4).replace(" ", "") for _ in range(100))],
    ids=["repeats", "lines", "symbols", "long words"])
def test_each_statistic_alone_rejects(spark, bad):
    good = [(i, prose(rnd.randint(60, 300)), "en", "a") for i in range(200)]
    good += [(300 + i, lined(30, 0), "en", "a") for i in range(100)]
    got = judged(spark, good + [(1000 + i, bad(), "en", "a") for i in range(10)])
    assert all(got[i].kept for i, *_ in good) and not any(got[1000 + i].kept for i in range(10))


def test_a_small_group_of_junk_is_judged_by_all(spark):
    good = [(i, prose(rnd.randint(60, 300)), "en", f"s{i % 4}") for i in range(440)]
    junk = [(1000 + i, " ".join(w + "###%" for w in prose(100).split()), "xx", "junk") for i in range(30)]
    got = judged(spark, good + junk)
    assert all(got[i].kept for i, *_ in good) and not any(got[i].kept for i, *_ in junk)


def test_stage_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, prose(50), "en", "a", i, "x") for i in range(30)] + [(None, None, None, None, None, None)] * 2
    rows += [(7, rows[7][1], "en", "a", 7, "y"), (None, prose(40), None, None, 1, "z"), (40, "", "en", "a", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", n_chars bigint, kept string")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 32
    assert sorted(r.kept for r in kept.collect() if r.doc_id == 7) == ["x", "y"]
    assert quality.keep_good(df.where("doc_id is null and text is null")).count() == 0
