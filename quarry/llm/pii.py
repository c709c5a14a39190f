"""Personal data by bootstrapped contextual extraction.

Fixed expressions find e-mail and IP addresses, card and phone numbers. They are the seeds: the
whole words around them, however long, are lexical patterns. Patterns and instances (seeds, and other words that hold
digits or an at sign) form a graph, scored in turns: a pattern by the share of its distinct
instances that are trusted, an instance by its patterns together. Instances that reach
``accept`` count as seeds in the next turn, so patterns around them alone come in too; the turns
start anew as long as any does. Instances that reach ``accept`` in patterns that do, but that no
expression finds, are reported as kind "context".

An instance that no expression finds is one word of at least four characters, with a digit or an at
sign in it: names and identifiers of letters alone or of several words are not looked for.

Texts are read once; the graph holds a row for each distinct (pattern, instance), aggregated
before it is shuffled.

Defined cases: a null text is empty; repeated rows each get their spans; a pattern needs
``support`` distinct seeds or accepted instances; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import count_kind, digest, stored, text_of

KINDS = ("email", "ip", "card", "phone")
# Expressions of the four kinds. A match can start only where the run of its first
# characters does, or where the match before has ended.
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]++", r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL = (re.compile(rf"(?<![A-Za-z0-9._%+-]){LOCAL}{DOMAIN}"), re.compile(LOCAL + DOMAIN))
IP = (re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), re.compile(r"[0-9]++(?:\.[0-9]++){3}"))
CARD = (re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+"),) * 2
PHONE = (re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),) * 2
MARK, FILLED = re.compile(r"[0-9@]\S*"), re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _card(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 14 <= len(d) <= 19 and luhn(d)


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in s.split("."))


def _phone(s: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in s) <= 15


RULES = (("email", "@", EMAIL, None), ("ip", ".", IP, _ip), ("card", "", CARD, _card), ("phone", "+", PHONE, _phone))


def _matches(text: str, first: re.Pattern, after: re.Pattern):
    at = 0
    while True:
        m = (after.match(text, at) if at else None) or first.search(text, at)
        if not m:
            return
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), kind) for kind, sign, (first, after), good in RULES if sign in text
            for m in _matches(text, first, after) if good is None or good(m[0])]


def _contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """Two patterns of each span: the two words before, and the words on both sides. Words end at
    white space and at the borders of spans; however long, a word is near few spans."""
    cuts = sorted({x for s in spans for x in s})
    first, last, k = [], [], 0
    for m in FILLED.finditer(text):
        a, end = m.span()
        while k < len(cuts) and cuts[k] < end:
            if cuts[k] > a:
                first.append(a)
                last.append(cuts[k])
                a = cuts[k]
            k += 1
        first.append(a)
        last.append(end)
    word = lambda i: text[first[i]:last[i]].lower()
    out = []
    for a, b in spans:
        i, j = bisect.bisect_right(last, a), bisect.bisect_left(first, b)
        two = f"{word(i - 2)} {word(i - 1)} _" if i > 1 else ""
        out.append((two, f"{word(i - 1)} _ {word(j)}" if i and j < len(first) else ""))
    return out


def occurrences(text: str, spans) -> list[tuple]:
    """(start, end, instance, pattern, pattern, is seed) of seeds and of words like identifiers."""
    found = [(a, b, True) for a, b, _ in spans]
    taken = sorted((a, b) for a, b, _ in spans)
    at = 0
    for m in MARK.finditer(text):
        a, b = m.start(), m.end()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b > a and text[b - 1] in ".,;:!?)\"'":
            b -= 1
        while a < b and text[a] in "(\"'":
            a += 1
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if b - a >= 4 and not (at < len(taken) and taken[at][0] < b):
            found.append((a, b, False))
    near = _contexts(text, [(a, b) for a, b, _ in found])
    return [(a, b, text[a:b].lower(), *p, seed) for (a, b, seed), p in zip(found, near)]


def extract(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    src = df.select(*[F.col(f"`{k}`") for k in keep], text_of(f"`{text}`").alias("_text"))
    span = "struct<start:int,end:int,kind:string>"
    occ = "struct<start:int,end:int,inst:string,p1:string,p2:string,seed:boolean>"

    def make(batches):
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            found, words = [], []
            for t in b.column("_text"):
                t = t.as_py()
                s = base_spans(t)
                found.append([dict(zip(("start", "end", "kind"), x)) for x in s])
                words.append([dict(zip(("start", "end", "inst", "p1", "p2", "seed"), x)) for x in occurrences(t, s)])
            types = [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])),
                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("inst", pa.string()),
                                         ("p1", pa.string()), ("p2", pa.string()), ("seed", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in keep] + [pa.array(range(rid, rid + len(found)), pa.int64()),
                                               pa.array(found, types[0]), pa.array(words, types[1])],
                [*keep, "_rid", "_base", "_occ"])
            rid += len(found)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    return stored(src.mapInArrow(make, f"{kinds}, _rid bigint, _base array<{span}>, _occ array<{occ}>"), "pii")


def scores(occ: DataFrame, turns: int, support: int, accept: float) -> tuple[DataFrame, DataFrame]:
    """(pattern, conf) and (inst, score) after ``turns`` turns that bring no new pattern, the one
    that brings the last included."""
    edges = occ.select("inst", "seed", F.explode(F.array("p1", "p2")).alias("pattern")).where(F.col("pattern") != "") \
        .groupBy("pattern", "inst").agg(F.max("seed").alias("seed"))
    # A pattern of fewer instances never has enough to trust. Every other may get them.
    some = edges.groupBy("pattern").agg(F.count("*").alias("c")).where(F.col("c") >= support).select("pattern")
    edges = stored(edges.join(some, "pattern"), "graph")
    seeds = edges.groupBy("inst").agg(F.max("seed").alias("seed")).where("seed").select("inst")
    edges = stored(edges.drop("seed").join(seeds.withColumn("seed", F.lit(True)), "inst", "left")
                   .withColumn("seed", F.coalesce("seed", F.lit(False))), "graph")
    inst, known, same = None, 0, 0
    while same < turns:
        scored = edges.withColumn("score", F.lit(0.0)) if inst is None else \
            edges.join(inst.select("inst", "score"), "inst", "left")
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        pattern = scored.withColumn("score", score).groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("conf"),
            F.count_if(F.col("score") >= accept).alias("c")).where(F.col("c") >= support)
        pattern = stored(pattern.select("pattern", "conf"), "patterns")
        # Scores only rise from turn to turn, so patterns stay once they are in.
        now = pattern.count()
        known, same = now, same + 1 if now == known and inst is not None else 1
        inst = edges.join(pattern, "pattern").groupBy("inst").agg(
            F.max("seed").alias("seed"), F.sum(F.log1p(-F.least("conf", F.lit(0.999999)))).alias("miss"))
        inst = stored(inst.select("inst", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("miss")).alias("score")), "instances")
    return pattern, inst


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, turns: int = 3,
         support: int = 5, accept: float = 0.8) -> DataFrame:
    """``keep`` columns of every row, and found: array<struct<start,end,kind>> of all spans."""
    keep = ["doc_id"] if keep is None else keep
    rows = extract(df, text, keep)
    occ = rows.select("_rid", F.explode("_occ").alias("o")).select("_rid", "o.*")
    pattern, inst = scores(occ, turns, support, accept)
    good = inst.where(F.col("score") >= accept).select("inst")
    trusted = pattern.where(F.col("conf") >= accept).select("pattern")
    seen = occ.where(~F.col("seed")).join(good, "inst") \
        .select("_rid", "start", "end", F.explode(F.array("p1", "p2")).alias("pattern")).join(trusted, "pattern")
    more = seen.groupBy("_rid").agg(F.collect_set(F.struct("start", "end", F.lit("context").alias("kind"))).alias("_more"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return rows.drop("_occ").join(more, "_rid", "left").select(
        *[F.col(f"`{k}`") for k in keep], F.concat("_base", F.coalesce("_more", none)).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts and span digests per row of ``find``."""
    f = F.col("found")
    return found.select(*[c for c in found.columns if c != "found"],
                        *[count_kind(f, k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(digest(f, KINDS), 256).alias("base_sha256"),
                        digest(f, [*KINDS, "context"]).alias("spans"), count_kind(f, "context").alias("n_context"))
