"""Phrase collocations by Rabin-Karp fingerprints.

Texts are read as bytes. A prefix polynomial over a slice's bytes gives the hash of every word, a
second one over the words' hashes the fingerprint of every n-gram (all modulo 2 ** 64; powers and
their inverses are tables). Each slice counts its fingerprints, and only the last ``FP_BITS`` bits
of each and its count are shuffled and summed. A phrase's fingerprint occurs at least as often as
the phrase, so those that reach the least count hold all frequent phrases.

A phrase is frequent only if its parts are. Words come first, then pairs of frequent words, then
three and four words of frequent pairs. What is frequent is passed on as a bit map of fixed size
(``MAP_BITS`` at most): it lets too much through when it fills up, which costs shuffle and never
a result. A last pass cuts out the phrases that the maps hold. A slice tells them apart word by
word (words of one hash are compared byte by byte), and counts are summed by phrase: so only
phrases that may be frequent are ever text, and the counts are exact whatever collides.

The texts are read four times and neither copied nor shuffled. Defined cases: a null text is
empty, a null language is ``und``; a piece has no phrase longer than itself; repeated rows count
each; an empty table gives an empty result; further columns are ignored. A slice is at least one
document; its arrays take some 10 bytes for each byte of the slice and 150 for each word.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored_tidy

SLICE = 2_000_000           # bytes of text whose fingerprints are counted together
HASHED = 400_000            # bytes whose prefix sums are held at once
MAP_BITS = 2 ** 28
FP_BITS = 40                # of a fingerprint, counted by the shuffle (more than a map's places)
LONGEST = 4                 # words of a phrase
SALTS = 64
CUT, CUT_BYTES = 200_000, 16_000_000        # phrases and bytes of an output batch
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93      # odd, so that they have inverses

KIND = np.zeros(256, np.uint8)          # 0 word, 1 blank, 2 end of a piece
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        both = []
        for b in (base, pow(base, -1, 2 ** 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = both[0], both[1]
    up, down = _POWERS[base]
    return up[:n], down[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times powers of the base."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], dtype=np.uint64, out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a slice: places in ``low``, hashes, exact identities, document and piece of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``offsets`` are the bounds of the documents in ``data``."""
        self.low, kind = LOWER[data], KIND[data]
        inside = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True                          # a document's first byte
        before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~first[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.piece = np.searchsorted(np.flatnonzero((kind == 2) | first[:-1]), self.start, side="right").astype(np.int32)
        self.doc = (np.searchsorted(offsets, self.start, side="right") - 1).astype(np.int32)
        self.hash = np.zeros(len(self.start), np.uint64)
        for a, z, lo, hi in self._runs():
            sums = prefix(self.low[lo:hi].astype(np.uint64) + np.uint64(1), BASE)
            s, e = self.start[a:z] - lo, self.end[a:z] - lo
            self.hash[a:z] = (sums[e] - sums[s]) * powers(BASE, hi - lo + 1)[1][s]
        self.hash = mixed(self.hash ^ (self.end - self.start).astype(np.uint64))

    def _runs(self):
        """Runs of words (first, last, first byte, last byte) of some ``HASHED`` bytes."""
        a = 0
        while a < len(self.start):
            lo = int(self.start[a])
            z = max(a + 1, int(np.searchsorted(self.end, lo + HASHED, side="right")))
            yield a, z, lo, int(self.end[z - 1])
            a = z

    @cached_property
    def word(self) -> np.ndarray:
        """A number for each word, equal exactly where the bytes are."""
        code, first = grouped(self.hash)
        length = self.end - self.start
        out = code.astype(np.int32)
        rest = self._differ(np.arange(len(code)), first[code], length)
        names = len(first)
        texts: dict[bytes, int] = {}
        for i in rest.tolist():                             # words whose hash another word has
            text = self.low[self.start[i]:self.end[i]].tobytes()
            out[i] = texts.setdefault(text, names + len(texts))
        return out

    def _differ(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Those of words ``i`` that are not the same bytes as the words ``j`` beside them."""
        other = length[i] != length[j]
        bad = [i[other]]
        i, j = i[~other & (i != j)], j[~other & (i != j)]
        for size in np.unique(length[i]).tolist():
            mine = length[i] == size
            for a, b in self._parts(i[mine], j[mine], size):
                at = np.arange(size)
                same = (self.low[self.start[a][:, None] + at] == self.low[self.start[b][:, None] + at]).all(axis=1)
                bad.append(a[~same])
        return np.concatenate(bad)

    @staticmethod
    def _parts(a: np.ndarray, b: np.ndarray, size: int):
        step = max(1, 1_000_000 // size)
        for k in range(0, len(a), step):
            yield a[k:k + step], b[k:k + step]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each key, first place of each group)."""
    code, names = pd.factorize(keys)
    first = np.zeros(len(names), np.int64)
    first[code[::-1]] = np.arange(len(keys))[::-1]          # the smallest place is written last
    return code, first


def grams(w: Words, salt: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, fingerprints) of the slice's n-grams; ``salt`` is a number for each word's language."""
    m = len(w.start) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.piece[:m] == w.piece[n - 1:])
    fp = (sums[at + n] - sums[at]) * powers(STEP, m)[1][at]
    return at, mixed(fp ^ salt[at] ^ np.uint64(n))


def counted(w: Words, at: np.ndarray, fp: np.ndarray, lang: np.ndarray, n: int):
    """(first word, fingerprint, count) of equal n-grams, told apart by their words and language."""
    while len(at):
        code, first = grouped(fp)
        same = lang[at] == lang[at[first[code]]]
        for k in range(n):
            same &= w.word[at + k] == w.word[at[first[code]] + k]
        yield at[first], fp[first], np.bincount(code[same], minlength=len(first))
        at, fp = at[~same], fp[~same]


def _held(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    x = fp & np.uint64(64 * len(bits) - 1)
    return (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of the texts, their bytes)."""
    kind = np.int32 if pa.types.is_string(text.type) else np.int64
    place = np.frombuffer(text.buffers()[1], kind)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    return place, np.frombuffer(text.buffers()[2] or b"", np.uint8)


def by_slice(docs: DataFrame, use, schema: str) -> DataFrame:
    """The record batches of ``use(words, language number of each word, salts, languages)`` over all slices."""
    def work(batches):
        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang")
            place, data = _bytes_of(text)
            code, names = pd.factorize(lang.to_numpy(zero_copy_only=False))
            salts = np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little") for s in names], np.uint64)
            a = 0
            while a < len(text):
                z = max(a + 1, int(np.searchsorted(place, place[a] + SLICE, side="right")) - 1)
                w = Words(data[place[a]:place[z]], place[a:z + 1] - place[a])
                if len(w.start):
                    yield from use(w, code[a:z][w.doc], salts, names)
                a = z

    return docs.mapInArrow(work, schema)


def held_grams(w: Words, salt: np.ndarray, sizes: tuple[int, ...], maps: dict[int, bytes]):
    """(n, first words, fingerprints) of the slice's n-grams of the given sizes that the maps hold,
    themselves and their parts, as far as there is a map for that size."""
    sums = prefix(w.hash, STEP)
    ok = {}             # what the maps hold, by first word
    for n in range(1, max(sizes) + 1):
        if n not in sizes and n not in maps:
            continue
        at, fp = grams(w, salt, n, sums)
        keep = np.ones(len(at), bool)
        for size, held in ok.items():
            for k in range(n - size + 1):
                keep &= held[at + k]
        at, fp = at[keep], fp[keep]
        if n in maps:
            keep = _held(np.frombuffer(maps[n], np.uint64), fp)
            at, fp = at[keep], fp[keep]
            ok[n] = np.zeros(len(w.start) + LONGEST, bool)
            ok[n][at] = True
        if n in sizes:
            yield n, at, fp


def counts(docs: DataFrame, sizes: tuple[int, ...], maps: dict[int, bytes]) -> DataFrame:
    """Counts by slice of the fingerprints of the given sizes whose parts the maps hold."""
    def use(w, lang, salts, names):
        for _, _, fp in held_grams(w, salts[lang], sizes, maps):
            code, fps = pd.factorize(fp & np.uint64(2 ** FP_BITS - 1))
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(np.bincount(code, minlength=len(fps)))], ["fp", "cnt"])

    return by_slice(docs, use, "fp bigint, cnt bigint")


def frequent(found: DataFrame, least: int) -> DataFrame:
    """The fingerprints whose counts add up to ``least``. Tasks add up their own before the shuffle,
    so that a hot fingerprint has one row for each task."""
    total = found.groupBy("fp").agg(F.sum("cnt").alias("cnt"))
    return stored_tidy(total.where(F.col("cnt") >= least).select("fp"), "fingerprints")


def bit_map(fps: DataFrame) -> bytes:
    """Distinct fingerprints as a bit map; at most ``MAP_BITS`` bits reach the driver."""
    size = 1 << max(fps.count() * 16, 64).bit_length()
    size = min(size, MAP_BITS)
    x = F.col("fp").bitwiseAND(F.lit(size - 1))
    one = F.expr("shiftleft(1L, CAST(fp & 63L AS INT))")
    got = fps.groupBy(F.shiftright(x, 6).alias("i")).agg(F.bit_or(one).alias("w")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(np.int64).view(np.uint64)
    return bits.tobytes()


def _texts(low: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(first, last, texts) of batches of phrases, cut out of the bytes."""
    # Phrases with a tab or two blanks in a row are joined again, all others are cut out as they are.
    blank = np.flatnonzero((low == 9) | (low == 32))
    blank = blank[(low[blank] == 9) | (low[np.minimum(blank + 1, len(low) - 1)] == 32)]
    odd = np.flatnonzero(np.searchsorted(blank, start) < np.searchsorted(blank, start + size))
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(start):
        z = max(a + 1, min(a + CUT, int(np.searchsorted(total, total[a] + CUT_BYTES, side="right")) - 1))
        ends = total[a:z + 1] - total[a]
        at = np.arange(ends[-1]) + np.repeat(start[a:z] - ends[:-1], size[a:z])
        phrase = pa.StringArray.from_buffers(z - a, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(low[at]))
        mine = odd[(odd >= a) & (odd < z)]
        if len(mine):
            parts = [b" ".join(low[start[i]:start[i] + size[i]].tobytes().replace(b"\t", b" ").split()).decode() for i in mine]
            mask = np.zeros(z - a, bool)
            mask[mine - a] = True
            phrase = pc.replace_with_mask(phrase, pa.array(mask), pa.array(parts, pa.string()))
        yield a, z, phrase
        a = z


def materialise(docs: DataFrame, maps: dict[int, bytes], least: int) -> DataFrame:
    """lang, n, phrase, f: the phrases that the maps hold with their exact counts, and with n = 0
    all words of a language."""
    def rows(names, lang, phrase, f):
        name = pa.array(names, pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([name, phrase, pa.array(f.astype(np.int64))], ["lang", "phrase", "f"])

    def use(w, lang, salts, names):
        for n, at, fp in held_grams(w, salts[lang], tuple(range(1, LONGEST + 1)), maps):
            for first, _, f in counted(w, at, fp, lang, n):
                for a, z, phrase in _texts(w.low, w.start[first], w.end[first + n - 1] - w.start[first]):
                    yield rows(names, lang[first[a:z]], phrase, f[a:z])
        got, first = grouped(lang)
        yield rows(names, lang[first], pa.array([""] * len(first), pa.string()), np.bincount(got))

    got = by_slice(docs, use, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    n = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return stored_tidy(got.where(F.col("f") >= least).select("lang", n.alias("n"), "phrase", "f"), "phrases")


def count_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30) -> DataFrame:
    """lang, n, phrase, f of all phrases of up to four words with f >= ``least``, and with n = 0
    and an empty phrase the number of words of each language (if that many)."""
    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    maps = {}
    for sizes in ((1,), (2,), (3, 4)):
        maps = maps | dict.fromkeys(sizes, bit_map(frequent(counts(docs, sizes, maps), least)))
    return materialise(docs, maps, least)


def _part(a, b) -> Column:
    return F.array_join(F.slice("w", a, b), " ")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000,
                 scale: int = 2_000_000, inside: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases.

    A phrase's score is that of its weakest cut into two parts; phrases that mostly occur inside
    a longer one (``inside`` per cent or more) go.
    """
    f = count_phrases(df, text, lang, least)
    one = f.where("n > 0").select("lang", "phrase", "f")
    cand = f.where("n > 1").withColumn("w", F.split("phrase", " "))
    cuts = cand.select("lang", "phrase", F.col("f").alias("a"), "n", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumn("x", _part(F.lit(1), F.col("k"))).withColumn("y", _part(F.col("k") + 1, F.col("n"))).drop("w", "n")
    left = one.select("lang", F.col("phrase").alias("x"), F.col("f").alias("l"))
    right = one.select("lang", F.col("phrase").alias("y"), F.col("f").alias("r"))
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {scale}BD) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.join(left, ["lang", "x"]).join(right, ["lang", "y"]).withColumn("score", score) \
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = cand.where("n > 2").select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m")) \
        .select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("i")) \
        .select("lang", "f", _part(F.col("i"), F.col("m")).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    kept = best.join(longer, ["lang", "phrase"], "left") \
        .where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * inside))
    kept = kept.select("lang", "phrase", "a", "b.*", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within salted parts, so that no task ranks all phrases of a language.
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = f.where("n = 0").select("lang", F.col("f").alias("n"))
    return some.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
