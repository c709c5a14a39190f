"""Phrase counts and collocations against plain Python, with hashes that collide."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(rows, least):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    return {k: v for k, v in f.items() if v >= least}, n


def brute(rows, least, top):
    f, n = count(rows, least)
    out = []
    for lang in n:
        mine = []
        for (g, w), a in f.items():
            if g != lang or len(w) < 2:
                continue
            score, k = min((2_000_000 * a // (f[g, w[:k]] + f[g, w[k:]]), k) for k in range(1, len(w)))
            inside = any(g2 == lang and len(v) > len(w) and 100 * b >= 80 * a
                         and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (g2, v), b in f.items() if len(v) > 2)
            if not inside:
                mine.append((-score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    vocab = ["New", "york", "É x", "the", "THE", "of", "ça", "中文", "x#y", "\U0001F600"] + [f"w{i}" for i in range(30)]
    gaps = [" ", " ", " ", " ", "  ", "\t", " \t", ". ", ",", "\n", ";", "\x0b"]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(vocab) + rnd.choice(gaps) for _ in range(rnd.randint(0, 90)))
        rows.append((rnd.choice(["en", "en", "fr", None]), text + " the city of New york. " * (i % 4)))
    rows += [("en", None), (None, ""), ("de", "  \t"), ("und", "the of the of"), rows[0], rows[0], ("en", "a b c d e f " * 2000)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, g, 1, 2, 3) for i, (g, t) in enumerate(rows)],
                               "doc_id int, text string, lang string, row int, n int, fp int").repartition(4)
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


@pytest.mark.parametrize("slice_bytes,least,top", [(4_000_000, 5, 2000), (300, 3, 20), (1500, 30, 7)])
def test_collocations(spark, monkeypatch, slice_bytes, least, top):
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    rows = corpus()
    assert run(spark, rows, least=least, top=top) == brute(rows, least, top)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("en", " . ")]) == []


def words(texts):
    raw = [t.encode() for t in texts]
    return phrases.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from([*"aAbB .,\t\né0"]), max_size=25), min_size=1, max_size=6), st.integers(1, 40), st.booleans())
def test_slice_counts_are_exact(texts, run_bytes, collide):
    """All n-grams of a slice, also when hashes collide all the time."""
    old = phrases.HASHED, phrases.mixed
    phrases.HASHED = run_bytes
    if collide:
        phrases.mixed = lambda x: x & np.uint64(3)
    try:
        w = words(texts)
        lang = np.zeros(len(w.start), np.int64)
        got = collections.Counter()
        sums = phrases.prefix(w.hash, phrases.STEP)
        for n in range(1, 5):
            at, fp = phrases.grams(w, np.zeros(len(w.start), np.uint64), n, sums)
            for first, _, c in phrases.counted(w, at, fp, lang, n):
                for i, x in zip(first.tolist(), c.tolist()):
                    got[" ".join(w.low[w.start[i + k]:w.end[i + k]].tobytes().decode() for k in range(n))] += x
        want, _ = count([("en", t) for t in texts], 1)
        assert got == {" ".join(k[1]): v for k, v in want.items()}
    finally:
        phrases.HASHED, phrases.mixed = old


def test_fingerprints_do_not_depend_on_place():
    w = words(["a few words here", "and here a few words", "few words"])
    sums = phrases.prefix(w.hash, phrases.STEP)
    at, fp = phrases.grams(w, np.zeros(len(w.start), np.uint64), 2, sums)
    by = {}
    for i, f in zip(at.tolist(), fp.tolist()):
        by.setdefault(f, []).append(i)
    assert sorted(by.values()) == [[0, 6], [1, 7, 9], [2], [4], [5]]


def test_full_map_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", 64)
    rows = corpus()
    assert run(spark, rows, least=5) == brute(rows, 5, 2000)


def test_texts_are_not_stored_and_slices_take_little_memory(spark, monkeypatch):
    """The numbered copy of the texts and slices of 8 MB took disk and the executors' memory."""
    kept = []
    store = phrases.stored_tidy
    monkeypatch.setattr(phrases, "stored_tidy", lambda df, name: kept.append((df.columns, name)) or store(df, name))
    rows = corpus()
    assert run(spark, rows, least=5) == brute(rows, 5, 2000)
    assert [k for k, _ in kept] == [["fp"]] * 3 + [["lang", "n", "phrase", "f"]]

    class Docs:
        def mapInArrow(self, work, schema):
            return work

    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(90_000)}" for _ in range(250)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})
    full = np.full(16, 2 ** 64 - 1, np.uint64).tobytes()
    for work in (phrases.counts(Docs(), (1,), {}), phrases.counts(Docs(), (3, 4), {1: full, 2: full})):
        tracemalloc.start()
        assert sum(pa.compute.sum(b.column("cnt")).as_py() for b in work([batch])) > 900_000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 120_000_000


def test_long_phrases_are_cut_in_batches(monkeypatch):
    monkeypatch.setattr(phrases, "CUT_BYTES", 10)
    low = np.frombuffer(b"abcdefghijklmno p  q r", np.uint8)
    got = list(phrases._texts(low, np.array([0, 16, 20, 21]), np.array([15, 4, 1, 1])))
    assert [(a, z) for a, z, _ in got] == [(0, 1), (1, 4)]
    assert [t for _, _, p in got for t in p.to_pylist()] == ["abcdefghijklmno", "p q", " ", "r"]
