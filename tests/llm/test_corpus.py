"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing extra columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import encoder, jaccard, mixing, packing, pii, quality, secret_scan, tokens, topk, url_lists, warc
from quarry.llm.common import fs_path, scratch
from quarry.llm.queries import OTHER, TOKENIZER, WEIGHTS

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, _h int, _cut int"
rnd = random.Random(7)
VOCAB = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def edited(text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
    return " ".join(w)


def corpus():
    base = prose(120)
    texts = [None, "", "   \n", "one two", "ONE two", base, base, base.upper().replace("ABC", "abc")]
    texts += [edited(base, k % 6) for k in range(40)]
    texts += [prose(rnd.randint(5, 200)) for _ in range(60)]
    texts += ["x " * 30_000, "é\U0001F600 " + prose(30) + " password=abcdef1 secret=token:abcdefgh",
              'API_KEY = "Zz9+/=.x_-12" AKIA' + "A" * 16 + " " + "0123456789abcdef" * 2,
              "mail a.b@c.d_x@y.zz ip 1.2.3.4.5.6.7.8 256.1.1.1 card 4111 1111 1111 1111 +1 (555) 555-2485"]
    texts += ["line a\nline a\n\nline b\nline a", "a b c d e a b c d e f"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, 1, "z", 3, 4) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base + " more", "en", "src1", 1, "z", 3, 4), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- quality

def stats(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_quality_statistics(docs):
    got = sorted(map(tuple, quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
    assert got == sorted(((r.doc_id, *stats(r.text)) for r in docs.collect()), key=repr)


def test_quality_rejects_outliers_and_keeps_prose(spark):
    rows = [(i, prose(rnd.randint(60, 300)), "en", "a", 1, "z", 1, 1) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###%" for w in prose(100).split()), "en", "a", 1, "z", 1, 1) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(20))


def test_quality_rejects_some_symbols_among_prose(spark):
    rows = [(i, prose(rnd.randint(60, 300)), "en", "a", 1, "z", 1, 1) for i in range(400)]
    rows += [(1000 + i, " | ".join(prose(3) for _ in range(60)), "en", "a", 1, "z", 1, 1) for i in range(20)]
    shares = [t.count("|") / sum(map(len, t.split())) for _, t, *_ in rows[400:]]
    assert 0.05 < min(shares) and max(shares) < 0.12
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(20))


def test_quality_stage_keeps_columns(docs, none):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and all(not stats(r.text)[5] for r in kept.collect())
    assert quality.keep_good(none).count() == 0


# ---- secrets

SECRET = [("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
           lambda m: len(m[1]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
          ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


def test_secret_spans(docs, none):
    got = secret_scan.report(secret_scan.scan(docs)).collect()
    by = sorted((r.doc_id, r.base_sha256) for r in got if r.doc_id is not None)
    want = sorted((r.doc_id, sha([(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(SECRET)
                                  for m in p.finditer(r.text or "") if ok(m)])) for r in docs.collect() if r.doc_id is not None)
    assert by == want and sum(r.n_assign + r.n_access + r.n_hex for r in got) >= 4
    assert secret_scan.scan(none).count() == 0


def test_secret_ledger_scans_each_pair_once(spark):
    ledger = scratch(spark, "ledger")
    df = spark.createDataFrame([(1, "token=abcdef99"), (2, "token=abcdef99"), (3, "plain")], "doc_id int, text string")
    secret_scan.update(df, ledger, secret_scan.BASE)
    assert secret_scan.read_ledger(spark, ledger).count() == 2
    secret_scan.update(df, ledger, secret_scan.BASE)
    assert secret_scan.read_ledger(spark, ledger).count() == 2
    more = df.union(spark.createDataFrame([(4, "new AKIA" + "B" * 16)], df.schema))
    rules = (secret_scan.Rule("assign", r"(token)=([a-z]+)", version=2, min_length=7), *secret_scan.BASE[1:])
    secret_scan.update(more, ledger, rules)
    log = secret_scan.read_ledger(spark, ledger)
    assert log.count() == 5 and log.where("tags = array('assign@2')").count() == 2
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secret_scan.findings(more, ledger, rules).collect()}
    assert got == {1: [("assign", 0, 12)], 2: [("assign", 0, 12)], 3: [], 4: [("access", 4, 24)]}


def test_redact(docs):
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(docs).count() == docs.count()
    for r in docs.collect():
        cut = sorted((m.start(), m.end()) for k, p, ok in SECRET for m in p.finditer(r.text or "") if ok(m))
        if r.doc_id is None or not cut:
            continue
        want, at = "", 0
        for a, b in cut:
            if b > at:
                want, at = (want + r.text[at:a] + "[secret]" if a >= at else want), b
        assert out[r.doc_id].text == want + r.text[at:]


def test_many_spans_in_a_long_text(spark):
    text = "\U0001F600token=abcdef " * 3000
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().found
    assert [(s.start, s.end) for s in got] == [(m.start(), m.end()) for m in re.finditer("token=abcdef", text)]


# ---- near copies

def gram_set(t, n):
    w = words((t or "").translate(str.maketrans(jaccard.UPPER, jaccard.LOWER)))
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def groups(rows, n, num, den):
    sets = [gram_set(r.text, n) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i) if sets[i] else ("none", i), []).append(i)
    return list(out.values()), sets


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_components(docs, n, num, den):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    parts, sets = groups(rows, n, num, den)
    want = {rows[i].doc_id: min(rows[j].doc_id for j in p) for p in parts for i in p}
    got = jaccard.join(docs.where("doc_id is not null"), "doc_id", "text", n, num, den).collect()
    assert {r.doc_id: r["first"].id for r in got} == want and len(got) == docs.where("doc_id is not null").count()
    assert {r.doc_id: r.n_shingles for r in got} == {r.doc_id: len(s) for r, s in zip(rows, sets)}


@pytest.mark.parametrize("num,den", [(1, 2), (4, 5), (85, 100), (9, 10), (97, 100)])
def test_screen_bound_holds_for_all_sizes(num, den):
    for a in range(1, 400):
        for b in range(a, a * den // num + 1):
            s = -(-num * (a + b) // (num + den))        # the fewest common n-grams of a link
            if s <= a:
                seen = min(jaccard.run_of(a, num, den) - (a - s), jaccard.run_of(b, num, den) - (b - s))
                assert seen >= max(jaccard.sure(a, num, den), jaccard.sure(b, num, den)) >= 1, (a, b, s)


def test_isolated_links_of_one_more_word(spark):
    rows = []
    for i, n in enumerate([9, 9, 8, 10, 12, 20, 40] * 6):
        w = [f"w{i}x{k}" for k in range(n)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "more"] if i % 2 else ["more", *w]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    parts, _ = groups(df.collect(), 4, 85, 100)
    got = {r.doc_id: r["first"].id for r in jaccard.join(df).collect()}
    assert got == {rows[i][0]: min(rows[j][0] for j in p) for p in parts for i in p} and len(parts) < len(rows)


def test_keep_one(docs, none):
    rows = docs.collect()
    parts, _ = groups(rows, 5, 4, 5)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(parts)
    assert jaccard.keep_one(none).count() == 0 and jaccard.join(none).count() == 0


# ---- mixing

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_period_keeps_every_window(weights):
    p, slots = sum(weights), mixing.period(weights)
    for i, e in enumerate(weights):
        at = [t for t, j in enumerate(slots) if j == i]
        assert len(at) == e
        assert all(k * p // e <= t < -(-(k + 1) * p // e) for k, t in enumerate(at))
    for t in range(p + 1):
        assert all(abs(slots[:t].count(i) - e * t / p) < 1 for i, e in enumerate(weights))


def test_mix_uses_every_row_once(docs, none):
    got = mixing.mix(docs, {"src0": 3, "src1": 2}, 4, block=500).collect()
    assert len(got) == docs.count()
    at = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        assert at.setdefault(r.mix_slot, r.mix_source) == r.mix_source
        assert r.mix_source == (r.source if r.source in ("src0", "src1") else "*")
    for s in ("src0", "src1", "*"):
        spans = sorted((r.mix_start, len(r.text or "")) for r in got if r.mix_source == s)
        place = 0
        for a, n in spans:
            assert a == place
            place += n
    out = mixing.mixed(docs, WEIGHTS, OTHER)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert mixing.mixed(none, WEIGHTS, OTHER).count() == 0


# ---- packing and token counts

def test_pieces_and_packing(docs, none):
    tok = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(packing.pieces(docs, TOKENIZER, limit=64), 64).collect()
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, k, a, len(ids[a:a + 64]), zlib.crc32(np.asarray(ids[a:a + 64], "<u4").tobytes()))
                 for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for a, n in sorted(b):
            assert a == end
            end += n
        assert end <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) * 1.05 + 1
    assert packing.pack(packing.pieces(none, TOKENIZER)).count() == 0


WORDY = st.sampled_from([*"aAeEiİIıßẞŸÉ'.,;|<>_-0129²½\u0301\u0307\n\t  \u0085Σς中é😀ªſɐȺ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>",
                         "<|startoftext|>", "<|", "|>", "'s", "'LL", "word", "Word.", "İ,", "aİ."])


@settings(max_examples=600, deadline=None)
@given(st.lists(WORDY, max_size=12))
def test_encoder_is_the_tokenizer(parts):
    text, tok = "".join(parts), encoder.encoder(TOKENIZER)
    assert tok.known
    for t in (text, text):      # the second time from kept words
        assert np.frombuffer(tok.text(t), "<u4").tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_gives_its_words_up(monkeypatch):
    monkeypatch.setattr(encoder, "MEMORY", 5000)
    tok = encoder.Encoder(TOKENIZER)
    for i in range(200):
        t = f"{prose(30)} {'long' * 40}{i} item-{i}."
        assert np.frombuffer(tok.text(t), "<u4").tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids
        assert tok.kept < 5000 + 100 * 400 and all(len(w) <= encoder.LONGEST for w in tok)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 9), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_capacity(lengths, docs_cap, rule):
    n = np.asarray(lengths, np.int64)
    bins, at = packing.best_fit(n, (50.0, float(docs_cap), 2600.0), (1.0, 0.5, 0.5), rule)
    for b in set(bins):
        mine = np.flatnonzero(bins == b)
        assert n[mine].sum() <= 50 and len(mine) <= docs_cap and (n[mine] ** 2).sum() <= 2600
        order = mine[np.argsort(at[mine])]
        assert list(at[order]) == [0, *np.cumsum(n[order])[:-1]]


def test_sequences_follow_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_SEQUENCES", 16)
    rows = [(i, prose(rnd.randint(100, 400)), "en", f"src{i % 2}", 1, "z", 1, 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    sizes = [len(r[1]) for r in rows]
    for weights in ({"src0": 3, "src1": 1}, {"src0": 1, "src1": 3}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        out = scratch(spark, "mix")
        corpus_pipeline.mix(spark, docs, "").write.parquet(out)
        got = corpus_pipeline.pack(spark, spark.read.parquet(out), "").collect()
        assert sorted(r.doc_id for r in got if r.piece == 0) == list(range(1200))
        first, seqs = {}, sorted({r.sequence_id for r in got})
        for r in got:
            first.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in first.values():
            end = 0
            for a, n in sorted(s):
                assert a == end
                end += n
            assert end <= 4096
        assert len(seqs) <= sum(r.length for r in got) / 4096 * 1.1 + 1
        # Until the heavier source runs out, each half of that stretch holds three parts of it to one.
        much = "src0" if weights["src0"] == 3 else "src1"
        stretch = int(len(seqs) * 4 / 3 * sum(n for r, n in zip(rows, sizes) if r[3] == much) / sum(sizes))
        for lo in (0, stretch // 2):
            mine = set(seqs[lo:lo + stretch // 2])
            tokens_of = {s: sum(r.length for r in got if r.sequence_id in mine and rows[r.doc_id][3] == s) for s in ("src0", "src1")}
            assert abs(tokens_of[much] / sum(tokens_of.values()) - 0.75) < 0.12


def test_token_scan(spark, docs, none, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 50)
    folder = scratch(spark, "tokens")
    who = tokens.write(docs, folder, TOKENIZER, 49407)
    got = tokens.scan(spark, folder, 49407).join(who, ["stream", "ordinal"], "full").collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = sorted(((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=repr)
    assert sorted(((r.id, r.n_tokens) for r in got), key=repr) == want and all(r.closed for r in got)


def test_token_scan_of_files_not_ours(spark, tmp_path):
    ids = [[5, 6, 9, 9, 7], [8, 8], [8, 9, 1]]
    for k, part in enumerate(ids):
        (tmp_path / f"stream-000003-{k:06d}.bin").write_bytes(np.asarray(part, "<u2").tobytes())
    got = sorted(map(tuple, tokens.scan(spark, f"file://{tmp_path}", 9).collect()))
    assert got == [(3, 0, 2, True), (3, 1, 0, True), (3, 2, 4, True), (3, 3, 1, False)]


def test_token_scan_of_one_large_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 7)
    monkeypatch.setattr(tokens, "RUN_BLOCKS", 3)
    gen = random.Random(2)
    ids = [gen.choice([9, 1, 2, 3, 4]) if i % 400 < 250 else 5 for i in range(5000)]
    cuts = [0, 1300, 1301, 1301, 4000, 5000]
    for k, (a, z) in enumerate(itertools.pairwise(cuts)):
        (tmp_path / f"stream-000001-{k:06d}.bin").write_bytes(np.asarray(ids[a:z], "<u2").tobytes())
    ends = [-1, *[i for i, x in enumerate(ids) if x == 9]]
    want = [(1, k, z - a - 1, True) for k, (a, z) in enumerate(itertools.pairwise(ends))]
    if ends[-1] < len(ids) - 1:
        want.append((1, len(want), len(ids) - 1 - ends[-1], False))
    assert sorted(map(tuple, tokens.scan(spark, f"file://{tmp_path}", 9).collect())) == want


# ---- personal data

def test_pii_base_spans(docs, none):
    kinds = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
             ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) < 256 for x in s.split("."))),
             ("card", re.compile("[0-9]([\x20-]?[0-9])+"), pii._card),
             ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= sum(c.isdigit() for c in s) <= 15)]
    got = pii.report(pii.find(docs)).collect()
    want = sorted((r.doc_id, sha([(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds)
                                  for m in p.finditer(r.text or "") if ok(m[0])])) for r in docs.collect() if r.doc_id is not None)
    assert sorted((r.doc_id, r.base_sha256) for r in got if r.doc_id is not None) == want
    assert sum(r.n_email for r in got) == 2 and sum(r.n_ip for r in got) == 2
    assert pii.find(none).count() == 0


def test_pii_finds_by_context(spark):
    rows = [(i, f"{prose(8)} please call +1 (555) 555-{1000 + i} today {prose(5)}") for i in range(40)]
    rows += [(100, "x please call ext-48213 today y"), (101, "we saw item-48999 in the shop")]
    got = {r.doc_id: r.spans for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id int, text string"))).collect()}
    assert got[100] == "context:14:23" and got[101] == ""
    assert all(got[i].startswith("phone:") and "context" not in got[i] for i in range(40))


def test_pii_follows_found_instances(spark):
    rows = [(i, f"{prose(8)} please call +1 (555) 555-{1000 + i} today {prose(5)}") for i in range(40)]
    rows += [(100 + i, f"x please call ext-50{i:03d} today y") for i in range(12)]
    rows += [(200 + i, f"his badge no ext-50{i:03d} here z") for i in range(12)]
    rows += [(300 + i, f"his badge no id-70{i:03d} here z") for i in range(2)]
    rows += [(400 + i, f"a desk key id-70{i % 2:03d} lost z") for i in range(2)]
    got = {r.doc_id: r.spans for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id int, text string"))).collect()}
    assert all(got[100 + i] == "context:14:23" and got[200 + i] == "context:13:22" for i in range(12))
    assert all(got[300 + i] == "context:13:21" and got[400 + i] == "" for i in range(2))


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


# ---- URL lists

def test_url_lists_as_of(spark):
    caps = spark.createDataFrame([
        (1, "http://a.b.com/x", 5, "k"), (2, "http://A.b.com:80/", 15, "k"), (3, "https://u:p@b.com?q", 25, "k"),
        (4, None, 5, "k"), (5, "nonsense", 5, "k"), (6, "http://a.b.com/x", None, "k"), (7, "http://xb.com", 5, "k"),
        (1, "http://a.b.com/x", 5, "k")], "page_id int, url string, at int, list_host string")
    ents = spark.createDataFrame([
        ("b.com", "block", "add", 0), ("b.com", "block", "remove", 20), ("a.b.com", "allow", "add", 10),
        ("a.b.com", "allow", "add", 10), (None, "block", "add", 0)], "pattern string, action string, op string, at int")
    got = url_lists.judge(caps, ents)
    assert got.columns[:4] == caps.columns and "_list_host" in got.columns
    by = [(r.page_id, r.list_verdict, r.list_pattern, r.list_active) for r in got.orderBy("page_id").collect()]
    assert by == [(1, "block", "b.com", 1)] * 2 + [(2, "allow", "a.b.com", 2), (3, "none", None, 0), (4, "none", None, 0),
                                                  (5, "none", None, 0), (6, "none", None, 0), (7, "none", None, 0)]
    assert url_lists.judge(caps.limit(0), ents).count() == 0
    assert url_lists.judge(caps, ents.limit(0)).where("list_verdict <> 'none'").count() == 0


def test_url_lists_compare_plain_hosts(spark):
    caps = spark.createDataFrame([(1, "http://www.Example.com./a", 1), (2, "http://1.2.3.4/", 1), (3, "http://x.3.4/", 1),
                                  (4, "http://b.org/" + "p" * 100_000, 1), (5, "http://./", 1)], "page_id int, url string, at int")
    ents = spark.createDataFrame([("Example.COM", "block", "add", 0), ("3.4", "block", "add", 0), ("B.org.", "allow", "add", 0),
                                  ("b.ORG", "allow", "remove", 9), ("1.2.3.4", "allow", "add", 0)], "pattern string, action string, op string, at int")
    got = [(r.page_id, r.list_pattern, r.list_verdict, r.list_active) for r in url_lists.judge(caps, ents).orderBy("page_id").collect()]
    assert got == [(1, "example.com", "block", 1), (2, "1.2.3.4", "allow", 1), (3, "3.4", "block", 1), (4, "b.org", "allow", 1), (5, None, "none", 0)]


# ---- search

def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(topk, "SLICE", 16)
    gen = np.random.default_rng(3)
    vecs = {i: gen.normal(size=12).round(1).tolist() for i in range(0, 400, 2)}
    vecs |= {i: vecs[0] for i in range(401, 420)}           # ties
    rows = [(i, v, 0) for i, v in vecs.items()] + [(501, None, 0), (503, [1.0, None] * 6, 0), (None, vecs[0], 0),
                                                   (505, [float("nan")] * 12, 0), (507, [1.0] * 3, 0), (509, [], 0)]
    # Repeated ids: of a query with the same and another vector, of a candidate, and many times.
    rows += [(0, vecs[0], 0), (0, vecs[2], 0), (7, vecs[0], 0), (7, vecs[4], 0), (600, [], 0), (601, [], 0)]
    rows += [(9, [9.0 + i % 3, *vecs[0][1:]], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, v int")
    got = sorted(map(tuple, topk.top_k(df, lambda i: i % 100 == 0).collect()))
    ints = [(i, np.floor(np.asarray(v, np.float32).astype(float) * 1024).astype(np.int64)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in ints if i % 100 == 0}:
        best = sorted((-int(a @ x), i) for j, a in ints if j == q for i, x in ints if i != q and len(x) == len(a))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and (600, 1, 509, 0) in got and sum(r[2] == 9 for r in got) > 10
    assert topk.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


# ---- WARC

@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree(runs):
    got = [x for x, _ in warc.LoserTree([sorted(r) for r in runs])]
    assert got == sorted(itertools.chain.from_iterable(runs))


def test_warc_round_trip(spark):
    rows = [(i, f"http://h{i % 3}.x.org/p{i % 4}", "same" if i % 2 else f"<p>{i}é\r\n\r\n</p>", "c") for i in range(1, 30)]
    rows += [(30, None, None, "c"), (31, "http://a.org/ b\n", "", "c"), (32, "http://a.org", "y" * 300_000, "c"), rows[2], (None, "u", "same", "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, body string").repartition(4)
    got = warc.round_trip(df, ts=F.col("page_id") % 5).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    text = {i: h or "" for i, _, h, _ in rows}
    for r in got:
        h = text[r.page_id]
        assert r.payload_bytes == len(h.encode())
        other = first[h] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if other else ("response", None))
    order = [(r.url_key, r.ts) for r in sorted(got, key=lambda r: (r.part, r.pos))]
    assert order == sorted(order)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_records_are_standard(spark):
    """Every record of the files, read one gzip member after another, has its type's mandatory fields."""
    rows = [(i, f"http://h{i}.org/", "same" if i % 2 else f"<p>{i}</p>") for i in range(1, 9)] + [(3, "http://h3.org/", "same"), (None, None, None)]
    folder = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2), folder, ts=F.lit(1_700_000_000))
    fs, path = fs_path(folder)
    ids, kinds = [], {}
    for info in fs.get_file_info(FileSelector(path)):
        if not info.path.endswith(".warc.gz"):
            continue
        data, first = fs.open_input_file(info.path).read(), True
        while data:
            member = zlib.decompressobj(31)
            raw = member.decompress(data)
            data = member.unused_data
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
            head, block = raw.split(b"\r\n\r\n", 1)
            h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert int(h["Content-Length"]) == len(block) - 4 and re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", h["WARC-Record-ID"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"])
            ids.append(h["WARC-Record-ID"])
            kind = h["WARC-Type"]
            kinds[kind] = kinds.get(kind, 0) + 1
            assert (kind == "warcinfo") == first
            first = False
            if kind == "warcinfo":
                assert h["Content-Type"] == "application/warc-fields" and h["WARC-Filename"]
            else:
                assert re.match("[a-z]+:.", h["WARC-Target-URI"]) and h["Content-Type"] == "application/http; msgtype=response"
                http, _, payload = block[:-4].partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK\r\n")
                if kind == "revisit":
                    assert h["WARC-Profile"].endswith("/identical-payload-digest") and not payload
                else:
                    assert h["WARC-Payload-Digest"][5:] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert len(set(ids)) == len(ids) and kinds["response"] + kinds["revisit"] == len(rows) and kinds["revisit"] == 4
