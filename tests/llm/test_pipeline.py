"""The pipeline from end to end, places in order, null ids in a mixture, context words."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import mixing, pii
from quarry.llm.common import running, scratch
from quarry.llm.queries import OTHER, TOKENIZER, WEIGHTS

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mix_slot string, id string, piece int"
rnd = random.Random(23)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def corpus():
    texts = [prose(rnd.randint(40, 200)) for _ in range(60)]
    long = prose(6000)
    near = texts[3].split()
    near[5] = "other"
    texts += [texts[0], texts[1], " ".join(near), long, None, "", "  \n ", "too few words",
              texts[7] + " password=abcdef12345 end", " ".join(w + "###%" for w in prose(80).split()), prose(39)]
    rows = [(i, t, "en" if i % 4 else None, f"src{i % 7}" if i % 5 else None, 1, "z", "y", 9) for i, t in enumerate(texts)]
    return rows + [rows[10], (None, prose(60), None, None, None, None, None, None), (None, prose(70), "en", "src0", 1, "z", "y", 9)]


CORPUS = corpus()


def kept_texts(rows):
    """Groups of texts that pass the quality rules, one of which stays: word shingles of five, 0.8."""
    good = [r for r in rows if r[1] and len(r[1].split()) >= 10 and "###%" not in r[1]]
    grams = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (r[1].split() for r in good)]
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return good, group


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(CORPUS, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_run_keeps_one_of_each_group_whole(done):
    good, group = kept_texts(CORPUS)
    tok = Tokenizer.from_file(TOKENIZER)
    crc = lambda t: [(k, len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for ids in [[
        *tok.encode(t, add_special_tokens=False).ids, 1]] for k, p in enumerate(ids[a:a + 4096] for a in range(0, len(ids), 4096))]
    got = {}
    for r in done:
        got.setdefault((r.doc_id, r.start == 0 and r.ids_crc32) if r.doc_id is None else r.doc_id, []).append((r.piece, r.length, r.ids_crc32))
    assert len({g for g in group}) == len(got)
    for g in set(group):
        mine = [r for r, x in zip(good, group) if x == g]
        if any("password" in r[1] for r in mine):
            assert all(sorted(got.get(r[0], [])) != crc(r[1]) for r in mine if "password" in r[1])
        elif mine[0][0] is not None:
            found = [r for r in mine if r[0] in got]
            assert found and any(sorted(got[r[0]]) == crc(r[1]) for r in found)
        else:
            assert crc(mine[0][1]) in [sorted(p) for p in got.values()]


def test_run_packs_without_gaps(done):
    room = {}
    for r in done:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in room.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 4096


def test_pack_does_not_look_at_files(spark):
    rows = [(i if i % 11 else None, prose(rnd.randint(30, 200)), "en", f"src{i % 8}", 1, "z", "y", 9) for i in range(300)]
    out, other = scratch(spark, "mix"), scratch(spark, "mix")
    corpus_pipeline.mix(spark, spark.createDataFrame(rows, SCHEMA), "").write.parquet(out)
    laid = spark.read.parquet(out)
    laid.repartition(7, F.rand(5)).write.parquet(other)
    got = [sorted((r.doc_id or -1, r.ids_crc32, r.sequence_id, r.offset) for r in corpus_pipeline.pack(spark, df, "").collect())
           for df in (laid, spark.read.parquet(other))]
    assert got[0] == got[1] and len(got[0]) == 300


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        assert got.count() == 0
        if name != "pack":
            assert got.columns == docs.columns


def test_running_sums(spark):
    rows = [(g, i, rnd.randint(0, 9)) for g in "ab" for i in rnd.sample(range(3000), 700)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    for by in (["g"], []):
        src = df if by else df.where("g = 'a'")
        for r in running(src, by, "i", "v", "before", stride=100).collect():
            assert r.before == sum(v for g, i, v in rows if g == r.g and i < r.i)


def test_null_and_repeated_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(None if i % 2 else 7, "x" * rnd.randint(1, 900), "src0", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint")
    got = mixing.mix(df, WEIGHTS, OTHER).collect()
    spans = sorted((r.mix_start, r.mix_start + len(r.text)) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    # In id order 2000 null ids would stand together; spread over buckets they alternate.
    order = [r.doc_id for r in sorted(got, key=lambda r: r.mix_start)]
    assert 800 < sum(x is None for x in order[:2000]) < 1200


def contexts(text, spans):
    """By the definition: words are cut at white space and at the borders of spans."""
    cuts = {x for s in spans for x in s}
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    parts = []
    for a, b in words:
        at = [a, *sorted(c for c in cuts if a < c < b), b]
        parts += list(zip(at, at[1:]))
    out = []
    for a, b in spans:
        left = [text[x:y].lower() for x, y in parts if y <= a][-2:]
        right = [text[x:y].lower() for x, y in parts if x >= b][:1]
        out.append((" ".join(left) + " _" if len(left) == 2 else "", f"{left[-1]} _ {right[0]}" if left and right else ""))
    return out


def test_context_words_are_whole():
    for _ in range(300):
        text = "".join(rnd.choice("ab  .@1\n") for _ in range(rnd.randint(0, 60)))
        spans = [tuple(sorted(rnd.sample(range(len(text) + 1), 2))) for _ in range(4) if len(text) > 2]
        assert pii._contexts(text, spans) == contexts(text, spans)
    far = "A" * 300
    text = f"{far} b{' ' * 200}x@y.zz {far}"
    a = text.index("x@")
    assert pii._contexts(text, [(a, a + 6)]) == [(f"{far.lower()} b _", f"b _ {far.lower()}")]
