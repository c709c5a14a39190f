"""Id files against the tokenizer: planes and files round trip, places, counts and checksums."""

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bitplanes
from quarry.llm.common import scratch
from quarry.llm.queries import TOKENIZER


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70), st.booleans())
def test_planes_round_trip(values, bits):
    a = np.array(values, "<u4")
    planes = bitplanes.planes_of(a, bits)
    assert len(planes) == (32 if bits else 4)
    assert bitplanes.values_of(planes, len(a), "<u4", bits).tolist() == values


def test_planes_are_transposed():
    a = np.array([1, 258, 3], "<u4")
    assert bitplanes.planes_of(a) == [b"\x01\x02\x03", b"\x00\x01\x00", b"", b""]
    assert bitplanes.planes_of(a, True)[:2] == [bytes([0b10100000]), bytes([0b01100000])]


class Memory(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()

    def read_at(self, n, at):
        return self.kept[at:at + n]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-2**63, 2**63 - 1), st.integers(0, 30)), max_size=25),
       st.integers(1, 9), st.booleans())
def test_file_round_trip_from_any_chunk(docs, block, bits):
    out = Memory()
    w = bitplanes.ChunkWriter(out, block, bits)
    want, at = [], 0
    for k, (doc, n) in enumerate(docs):
        ids = [(k * 7919 + i) % 70_000 for i in range(n)]
        w.add(doc, np.array(ids, "<u4").tobytes())
        want.append((doc, at, ids))
        at += n
    w.close()
    assert w.size == len(out.kept)
    read = lambda lo, hi: [(d, a, [int(x) for p in parts for x in p]) for d, a, parts in
                           bitplanes.ChunkReader(out, len(out.kept)).read(lo, hi)]
    n = bitplanes.ChunkReader(out, len(out.kept)).chunks
    assert read(0, n) == want and bitplanes.ChunkReader(out, len(out.kept)).n_ids == at
    assert [x for k in range(n) for x in read(k, k + 1)] == want


def test_cut_off_file_is_refused():
    out = Memory()
    w = bitplanes.ChunkWriter(out)
    w.add(1, b"\x01\0\0\0")
    w.close()
    out.kept = out.kept[:-3]
    with pytest.raises(ValueError):
        bitplanes.ChunkReader(out, len(out.kept))


@pytest.mark.parametrize("bits", [False, True])
def test_documents_in_order(spark, monkeypatch, bits):
    monkeypatch.setattr(bitplanes, "RUN", 2)
    monkeypatch.setattr(bitplanes, "GROUP_FILES", 2)
    texts = [None, "", " \n", "a # b", "# #", "Ünïcode İ, <|endoftext|>", "word " * 3000] + [f"text number {i}" for i in range(40)]
    rows = [(3 * (i * 17 % 47), t, 7, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id", 1, "x"), (None, "again", 1, "x"), rows[3], (-5, "first of all", 1, "x")]
    rows += [(1000, f"hot {i}", 1, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int, file string").repartition(5).cache()
    folder = scratch(spark, "planes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # so small a table would be one file
    try:
        files = bitplanes.write(df, folder, TOKENIZER, end_id=2, bits=bits, block=64).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files) > 2 and max(f.documents for f in files) < 250     # the hot id spreads
    got = sorted(bitplanes.read(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(TOKENIZER)
    enc = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    place = 0
    for r in got:
        assert r.start == place and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        place += r.n_tokens
    key = lambda i: (i is not None, i or 0)
    assert [key(r.id) for r in got] == sorted(key(r[0]) for r in rows)
    assert sorted(((key(r.id), r.ids) for r in got)) == sorted((key(i), enc(t)) for i, t, *_ in rows)


def test_empty_table_and_narrow_ids(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    folder = scratch(spark, "planes")
    bitplanes.write(empty, folder, TOKENIZER, end_id=2)
    assert bitplanes.read(spark, folder).count() == 0
    folder = scratch(spark, "planes")
    bitplanes.write(spark.createDataFrame([(4, "")], empty.schema), folder, TOKENIZER, end_id=2)
    assert [(r.id, r.start, r.n_tokens) for r in bitplanes.read(spark, folder).collect()] == [(4, 0, 1)]
