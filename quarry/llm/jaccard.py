"""N-gram Jaccard join: texts whose sets of word n-grams overlap by a threshold.

1. Sets. Words are hashed in the JVM, n-grams and their distinct sorted sets in Arrow batches.
2. Screen. A text of n n-grams can miss at most ``n - ceil(t n)`` of them in any partner. Each
   asks about a slightly longer run of its n-grams in hash order. Of two partners, the run that
   ends first lies within the range of the other, so both see all of it but what is missed:
   ``sure`` is the least that this leaves over all sizes a partner can have.
   Occurrences are counted in buckets of hashes; an n-gram seen twice in a batch is sent once, so
   a hot one costs an entry per batch. Texts that fail have no partner. Of survivors
   with the same set, a class, one representative goes on.
3. Rare-first prefixes. Document frequencies over the survivors order their n-grams, rarest
   first. A pair must share an n-gram of both prefixes, pass the length and positional filters,
   and the suffix filter (the parities of 512 hash ranges bound from below how many n-grams
   after the match differ).
4. Verification, once per pair, of whole sets. Lists of a prefix n-gram are first joined to one
   member each (a few rounds, each with other members); what then still spans several
   components is joined pair by pair. So a group of k near copies costs some k pairs, and no link
   between different components is lost.

Defined cases: a null or empty text has no n-grams and links with nothing; a text of fewer words
than n is one n-gram; repeated rows are in one class, a null id is a value as any other; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, stored, text_of, words
from quarry.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARITY = [f"p{i}" for i in range(8)]    # 64 hash ranges each, for the suffix filter
BUCKETS, BUCKET_TOKENS = 256, 500_000   # of the screen: at least, and n-grams that one task counts
HUB_ROUNDS = 3
MAP_BITS = 1 << 22
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text's word hashes."""
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h + w[i:len(w) - k + 1 + i]) * STEP + np.uint64(i)
    return np.unique(_mix(h))


def need(n, num, den):
    """ceil(t n)."""
    return (num * n + den - 1) // den


def run_of(n: int, num: int, den: int) -> int:
    """How many of its n n-grams a text asks about."""
    return min(n, 2 * (n - need(n, num, den)) + 4)


def sure(n, num, den):
    """Asked n-grams that a text of n has in common with those asked by any partner, at least.

    A partner has ceil(t n) n-grams or more. A run less what can be missed of it,
    ``min(ceil(t n), n - ceil(t n) + 4)``, grows with n, so the smallest partner bounds both runs.
    """
    least = need(n, num, den)
    return min(need(least, num, den), least - need(least, num, den) + 4)


def gram_sets(df: DataFrame, id_col: str, text: str, n: int, num: int, den: int, whole: bool) -> DataFrame:
    """rid (a number of the row), id, th (text hash), n, sig, and n-gram hashes: all as ``grams``,
    or 48 bits of those that the screen asks about as ``keys``."""
    t = text_of(f"`{text}`")
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("th"),
                    F.transform(words(F.translate(t, UPPER, LOWER)), lambda w: F.xxhash64(w)).alias("w"))

    def make(batches):
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            w = batch.column("w")
            flat, off = w.values.to_numpy(zero_copy_only=False).view(np.uint64), w.offsets.to_numpy()
            for lo in range(0, len(w), 1000):
                sets = [_grams(flat[off[i]:off[i + 1]], n) for i in range(lo, min(len(w), lo + 1000))]
                part = batch.slice(lo, len(sets))
                cols = [pa.array(np.arange(rid, rid + len(sets))), part.column("id"), part.column("th"),
                        pa.array([len(g) for g in sets], pa.int32()),
                        pa.array([hashlib.md5(g.tobytes()).hexdigest() for g in sets])]
                rid += len(sets)
                if whole:
                    ends = np.cumsum([0] + [len(g) for g in sets]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(np.concatenate(sets).view(np.int64), pa.int64())))
                else:
                    cols.append(pa.array([_short(g[:run_of(len(g), num, den)]) for g in sets],
                                         pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["rid", "id", "th", "n", "sig", "grams" if whole else "keys"])

    kind = src.schema["id"].dataType.simpleString()
    last = "grams array<bigint>" if whole else "keys binary"
    return src.mapInArrow(make, f"rid bigint, id {kind}, th bigint, n int, sig string, {last}")


def _short(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _long(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def screen(asked: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``asked`` whose asked n-grams occur often enough in other rows."""
    tokens = asked.agg(F.sum(F.length("keys"))).first()[0] or 0
    buckets = max(BUCKETS, tokens // 6 // BUCKET_TOKENS + 1)

    def send(batches):
        for number, batch in enumerate(batches):
            blobs = batch.column("keys").to_pylist()
            flat = _long(b"".join(blobs))
            if not len(flat):
                continue
            rid = np.repeat(batch.column("rid").to_numpy(), [len(b) // 6 for b in blobs])
            _, first, inv, cnt = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            many = cnt[inv] > 1
            lead = np.zeros(len(flat), bool)
            lead[first] = True
            bucket = (_mix(flat) % np.uint64(buckets)).astype(np.int32)
            out = {"bucket": [], "rids": [], "keys": [], "tally": []}
            # Found twice here: the rows' tallies, and one mark (rid -1) for other batches.
            ids, tally = np.unique(rid[many], return_counts=True)
            if len(ids):
                out["bucket"].append(int(ids[0] + number) % buckets)
                out["rids"].append(np.diff(ids, prepend=0).tobytes())
                out["keys"].append(b"")
                out["tally"].append(tally.astype(np.int32).tobytes())
            owner = np.where(many, -1, rid)
            rows = np.flatnonzero(~many | lead)
            order = rows[np.argsort(bucket[rows], kind="stable")]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                pick = order[cut[b]:cut[b + 1]]
                if len(pick):
                    out["bucket"].append(b)
                    out["rids"].append(np.diff(owner[pick], prepend=0).tobytes())
                    out["keys"].append(_short(flat[pick] << np.uint64(16)))
                    out["tally"].append(b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["bucket"], pa.int32()), pa.array(out["rids"], pa.binary()),
                 pa.array(out["keys"], pa.binary()), pa.array(out["tally"], pa.binary())],
                ["bucket", "rids", "keys", "tally"])

    def count(t: pa.Table) -> pa.Table:
        ids, tallies, keys, owners = [], [], [], []
        for r, k, c in zip(t.column("rids"), t.column("keys"), t.column("tally")):
            rid = np.cumsum(np.frombuffer(r.as_py(), np.int64))
            if k.as_py():
                keys.append(_long(k.as_py()))
                owners.append(rid)
            else:
                ids.append(rid)
                tallies.append(np.frombuffer(c.as_py(), np.int32))
        if keys:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            marked = np.logical_or.reduceat(owner < 0, start)
            run = np.diff(np.r_[start, len(key)])
            hit = np.repeat(marked | (run > 1), run) & (owner >= 0)
            got, c = np.unique(owner[hit], return_counts=True)
            ids.append(got)
            tallies.append(c.astype(np.int32))
        return pa.table({"rid": pa.array(np.concatenate(ids), pa.int64()),
                         "hits": pa.array(np.concatenate(tallies), pa.int32())})

    sent = asked.select("rid", "keys").mapInArrow(send, "bucket int, rids binary, keys binary, tally binary")
    hits = sent.groupBy("bucket").applyInArrow(count, "rid bigint, hits int") \
        .groupBy("rid").agg(F.sum("hits").alias("hits"))
    up = lambda n: F.floor((num * n + den - 1) / den)
    least = up(F.col("n"))
    return asked.select("rid", "id", "th", "sig", "n").join(hits, "rid") \
        .where(F.col("hits") >= F.least(up(least), least - up(least) + 4)).drop("hits")


def _likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in ``wanted`` (key) and few others: a bit map of fixed size, half a
    megabyte, goes to every task, so that most texts need no shuffle."""
    at = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    got = wanted.select((at / 64).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("b")) \
        .groupBy("i").agg(F.bit_or("b")).collect()      # at most MAP_BITS / 64 rows
    bits = [0] * (MAP_BITS // 64)
    for i, b in got:
        bits[i] = b
    one = F.broadcast(df.sparkSession.createDataFrame([(bits,)], "_bits array<bigint>"))
    word = F.get("_bits", (at / 64).cast("int"))
    return df.join(one, F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, "left_semi")


def postings(sets: DataFrame, num: int, den: int) -> DataFrame:
    """One row per rare-first prefix n-gram that another text holds: tok, rid, n, rest (such
    n-grams after it), far (less with common n-grams) and the parities of the rest."""
    flat = sets.select("rid", F.explode("grams").alias("tok"))
    often = flat.groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    order = flat.join(often, "tok").groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("o")) \
        .join(sets.select("rid", "n"), "rid").select("rid", "n", F.col("o.tok").alias("toks"), F.col("o.df").alias("dfs"))

    types = {"tok": pa.int64(), "rid": pa.int64(), "n": pa.int32(), "rest": pa.int32(), "far": pa.float64()} \
        | {c: pa.int64() for c in PARITY}

    def prefix(rid, n, toks, dfs):
        """The columns of one text's rows, or None."""
        # N-grams that no other text holds come first and take up prefix places.
        p = min(n - need(n, num, den) + 1 - (n - len(toks)), len(toks))
        if p <= 0:
            return None
        part = (toks.view(np.uint64) >> np.uint64(64 - 9)).astype(np.int64)
        odd = np.zeros((len(toks) + 1, len(PARITY)), np.uint64)
        odd[np.arange(len(toks)), part >> 6] = np.uint64(1) << (part & 63).astype(np.uint64)
        odd = np.bitwise_xor.accumulate(odd[::-1], axis=0)[::-1].view(np.int64)[1:p + 1]
        return (toks[:p], np.full(p, rid), np.full(p, n), np.arange(len(toks) - 1, len(toks) - 1 - p, -1),
                np.full(p, -np.log2(dfs).sum() / n), *odd.T)

    def make(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [prefix(*r) for r in zip(*(part.column(c).to_numpy(zero_copy_only=False)
                                                  for c in ("rid", "n", "toks", "dfs")))]
                rows = [r for r in rows if r is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), t) for c, t in zip(zip(*rows), types.values())], list(types))

    return order.mapInArrow(make, "tok bigint, rid bigint, n int, rest int, far double, "
                            + ", ".join(f"{c} bigint" for c in PARITY))


def _candidates(left: DataFrame, right: DataFrame, cond, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows that pass the length, positional and suffix filters."""
    l, r = left.alias("l"), right.alias("r")
    n = F.col("l.n") + F.col("r.n")
    overlap = F.floor((num * n + den + num - 1) / (den + num))
    # Each hash range of odd count in one suffix alone holds an n-gram of one alone.
    apart = sum((F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}"))) for c in PARITY[1:]),
                F.bit_count(F.col(f"l.{PARITY[0]}").bitwiseXOR(F.col(f"r.{PARITY[0]}"))))
    ok = ((F.col("l.tok") == F.col("r.tok")) & cond
          & (den * F.least("l.n", "r.n") >= num * F.greatest("l.n", "r.n"))
          & (F.least("l.rest", "r.rest") + 1 >= overlap)
          & (F.col("l.rest") + F.col("r.rest") - apart >= 2 * (overlap - 1)))
    return l.join(r, ok).select(F.least("l.rid", "r.rid").alias("a"), F.greatest("l.rid", "r.rid").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of each pair, from whole sets."""
    a = sets.select(F.col("rid").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("rid").alias("b"), F.col("grams").alias("gb"))
    same = F.size(F.array_intersect("ga", "gb"))
    got = pairs.join(a, "a").join(b, "b").select("a", "b", same.alias("s"),
                                                 (F.size("ga") + F.size("gb")).alias("n"))
    return got.select("a", "b", (den * F.col("s") >= num * (F.col("n") - F.col("s"))).alias("linked"))


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, comp) of the representatives that have a link, by rid."""
    post = stored(postings(sets, num, den), "postings")
    rows = post.count()
    spark, tested = sets.sparkSession, None
    label = spark.createDataFrame([], "id bigint, comp bigint")
    final, news = False, True
    for turn in range(HUB_ROUNDS + 1):
        mark = post
        if turn:
            lab = label.select(F.col("id").alias("rid"), "comp")
            mark = post.join(lab, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
            # Lists within one component have nothing more to tell.
            per = mark.groupBy("tok", "comp").agg(F.count("*").alias("c"))
            live = stored(per.groupBy("tok").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c").cast("double")).alias("q"))
                          .where(F.col("c") * F.col("c").cast("double") > F.col("q")), "live")
            left = live.agg(F.sum((F.col("c") * F.col("c").cast("double") - F.col("q")) / 2)).first()[0] or 0
            if not left:
                break
            final = left <= rows or not news or turn == HUB_ROUNDS
            mark = stored(mark.join(live.select("tok"), "tok"), "lists")
            post = mark.drop("comp")
        else:
            mark = mark.withColumn("comp", F.col("rid"))
        if final:
            pairs = _candidates(mark, mark, (F.col("l.rid") < F.col("r.rid")) & (F.col("l.comp") != F.col("r.comp")), num, den)
        else:
            # The member of most common n-grams of each component; of these, another one each turn.
            cols = [F.col(c) for c in ("rid", "n", "rest", "comp", *PARITY)]
            mid = mark.groupBy("tok", "comp").agg(F.min(F.struct("far", *cols)).alias("h")) if turn else \
                mark.select("tok", F.struct("far", *cols).alias("h"))
            turned = F.xxhash64("h.comp", F.lit(turn)) if turn else F.lit(0)
            hub = mid.groupBy("tok").agg(F.min(F.struct(turned.alias("k"), "h")).alias("h")).select("tok", "h.h.*")
            pairs = _candidates(hub, mark, F.col("l.comp") != F.col("r.comp"), num, den)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        got = stored(_verify(pairs, sets, num, den), "verified")
        tested = got if tested is None else stored(tested.unionByName(got), "verified")
        news = not got.where("linked").isEmpty()
        if news:
            label = components(tested.where("linked").select("a", "b"))
        if final:
            break
    return label


def join(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 4, num: int = 85,
         den: int = 100) -> DataFrame:
    """Self join on Jaccard similarity >= num / den: id, th, n_shingles, class_id, component.

    ``class_id`` is shared by texts with equal sets and ``component`` by texts that links
    connect; ``first`` is the smallest (id, th) of the component. Texts without n-grams have
    null classes and are their own ``first``.
    """
    asked = stored(gram_sets(df, id_col, text, n, num, den, False), "sets")
    alive = stored(screen(asked, num, den), "alive")
    classes = stored(alive.groupBy("sig").agg(F.min(F.struct("id", "th")).alias("first"), F.min("rid").alias("rid"))
                     .select("sig", "rid", "first"), "classes")
    # The survivors' whole sets, from their texts once more.
    here = fresh(df, "_id")
    some = df.select(F.col(f"`{id_col}`").alias(here), F.col(f"`{text}`").alias("text"))
    wanted = classes.select(F.col("first.id").alias(here)).distinct()
    some = _likely(some, here, wanted)
    some = some.join(wanted.withColumnRenamed(here, "id"), F.col(here).eqNullSafe(F.col("id")), "left_semi")
    full = gram_sets(some, here, "text", n, num, den, True).select("sig", "n", "grams")
    sets = stored(full.join(classes.select("rid", "sig"), "sig").groupBy("rid")
                  .agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "whole")
    label = links(sets, num, den)
    named = classes.join(label.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    firsts = named.groupBy("comp").agg(F.min("first").alias("first"))
    named = stored(named.select("sig", F.col("rid").alias("class"), "comp").join(firsts, "comp"), "components")
    some = F.col("n") > 0
    return asked.select("rid", "id", "th", "n", "sig").join(named, "sig", "left").select(
        F.col("id").alias(id_col), "th", F.col("n").cast("long").alias("n_shingles"),
        F.when(some, F.coalesce("class", "rid")).alias("class_id"),
        F.coalesce("comp", "rid").alias("component"), F.coalesce("first", F.struct("id", "th")).alias("first"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 4,
             den: int = 5) -> DataFrame:
    """The rows of ``df``, one of each component: that of the smallest id, then text hash.

    Rows equal in id and text are one document. Texts without n-grams all stay.
    """
    got = join(df, id_col, text, n, num, den)
    stay = stored(got.where(F.col(id_col).eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))
                  .select(F.col(id_col).alias("_i"), F.col("th").alias("_h"), "n_shingles"), "stay")
    h = F.xxhash64(text_of(f"`{text}`"))
    kept = df.join(stay, df[id_col].eqNullSafe(stay["_i"]) & (h == stay["_h"]), "left_semi")
    again = stay.where("n_shingles > 0").groupBy("_i", "_h").count().where("count > 1")
    if not again.isEmpty():
        empty = text_of(f"`{text}`").rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(empty).dropDuplicates([id_col, text]).unionByName(kept.where(~empty))
    return kept
