"""Quality rules: robust multivariate outliers.

Each text becomes a vector of transformed statistics (word length, symbols, repeated lines,
repeated words). Minimum-covariance-determinant estimates give centre and scatter of the regular
texts, per language and source, per language, and of all. A language's estimate is drawn towards
that of all texts, and a source's towards its language's, by the weight of ``prior`` texts: the
share of a group's own estimate grows with its size, n / (n + prior), and there is no size at which
the rule changes. A text whose Mahalanobis distance exceeds the cut-off is rejected, beside those
that fail the two fixed base rules.

Everything is DataFrame expressions. The texts are read once; the estimates then work on a table
of distinct integer vectors with their counts, so a hot source is one small set of counted
vectors, and all sums are sums of integers (equal in any order of rows).

Defined cases: a null or empty text has no words and fails; null languages or sources are groups
of their own; a group of few texts, also a language, is judged mostly by the wider estimate, a lone
text by that of all; repeated rows are judged alike, each row once; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, SPACES, small, stored, text_of, words

SCALE = 256                       # statistics are held as integers of 1/256
DIMS = ("x1", "x2", "x3", "x4")
PAIRS = [(i, j) for j in range(len(DIMS)) for i in range(j, len(DIMS))]
# Spread taken where the estimate has less, against singular matrices (most texts hold no symbol or
# repetition at all): one unit of x1; one symbol in 2500 characters; one repeated line among 25; one
# repeated window (ten words) in 300. x3 and x4 are plain shares, as a root would make one repeat
# in an ordinary text nearly as much as a fifth of all words.
FLOOR = (1 / SCALE, 0.02, 1 / 35, 1 / 35)
SUPPORT = 0.75                    # share of rows in the covered half-sample
TAIL = 1e-6                       # chi-square tail beyond which a text is an outlier
PRIOR = 50                        # words of ordinary prose mixed in, which steadies short texts
STEPS = 8                         # concentration steps, at most
PRIOR_TEXTS = 100                 # texts that the wider estimate stands for in a narrower one


def _chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dof // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, dof) < p else (lo, mid)
    return hi


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    t = text_of(text)
    keep = [F.col(f"`{c}`") for c in df.columns if c != text]
    base = df.select(*keep, t.alias("_t"), words(t).alias("_w"),
                     F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_l"))
    # One 64-bit value for each five-word window; only texts with a repeated one look further.
    base = base.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    gram = F.when(F.size("_h") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("_h") - 5),
        lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(5)])))
    base = base.withColumn("_g", F.coalesce(gram, F.array().cast("array<bigint>")))
    at = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    base = base.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), at))
    hit = F.filter("_s", lambda x, k: (F.get("_s", k - 1)["g"] == x["g"])
                   | (F.get("_s", k + 1)["g"] == x["g"]))
    base = base.withColumn("_p", F.sort_array(F.transform(hit, lambda x: x["i"])))
    # A repeated window covers its five words; overlapping windows share some.
    repeat = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
                         lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"),
                                               p.alias("last")), lambda a: a["n"])
    return base.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vector() -> list[Column]:
    n, c = F.col("n_words"), F.col("word_chars")
    xs = (F.log((c + 5 * PRIOR) / (n + PRIOR)), F.sqrt(F.col("n_symbols") / (c + 5 * PRIOR)),
          F.col("n_dup_lines") / (F.col("n_lines") + 10), F.col("n_repeat_words") / (n + PRIOR))
    return [F.round(x * SCALE).cast("long").alias(d) for x, d in zip(xs, DIMS)]


def _cholesky(est: DataFrame) -> DataFrame:
    """Add the lower factor l_ij of the covariance c_ij (i >= j), a variance left over below the floor
    being raised to it, and logdet."""
    p = len(DIMS)
    for j in range(p):
        for i in range(j, p):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            v = F.sqrt(F.greatest(v, F.lit((FLOOR[i] * SCALE) ** 2))) if i == j else v / F.col(f"l{j}{j}")
            est = est.withColumn(f"l{i}{j}", v)
    return est.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00")))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, d in enumerate(DIMS):
        v = F.col(d) - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _sums(v: DataFrame, *by: str) -> DataFrame:
    """Counts, sums s_i and sums of products s_ij of counted integer vectors (statistics are below
    5000 units, so 64 bits hold the sums of 3e11 texts; beyond, Spark raises)."""
    w = F.col("n")
    return v.groupBy("g", "start", *by).agg(
        F.sum(w).alias("s"), *[F.sum(F.col(d) * w).alias(f"s{i}") for i, d in enumerate(DIMS)],
        *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j]) * w).alias(f"s{i}{j}") for i, j in PAIRS])


def _moments(sums: DataFrame) -> DataFrame:
    """Mean and covariance per group and start."""
    s, m = F.col("s"), {i: F.col(f"s{i}").cast("double") / F.col("s") for i in range(len(DIMS))}
    return sums.select("g", "start", *[m[i].alias(f"m{i}") for i in m],
                       *[(F.col(f"s{i}{j}").cast("double") / s - m[i] * m[j]).alias(f"c{i}{j}") for i, j in PAIRS])


def estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate (m_i, c_ij) per group g of counted vectors (g, x1.., n).

    Two deterministic starts (median and median deviation; mean and covariance) are improved by
    concentration steps: each keeps the SUPPORT share of rows nearest to the present estimate
    and estimates again from those, until none changes or ``steps`` are done. The start that ends with the smaller
    determinant wins.
    """
    p = len(DIMS)
    off = [F.lit(0.0).alias(f"c{i}{j}") for j in range(p) for i in range(j + 1, p)]
    # Statistics are integers of a bounded range: the exact percentile keeps a bounded count map.
    med = stored(vectors.groupBy("g").agg(*[F.percentile(d, F.lit(0.5), F.col("n")).alias(f"m{i}")
                                            for i, d in enumerate(DIMS)]), "medians")
    dev = vectors.join(small(med), "g")
    mad = dev.groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)],
        *[F.pow(1.4826 * F.percentile(F.abs(F.col(d) - F.col(f"m{i}")), F.lit(0.5), F.col("n")), F.lit(2.0))
          .alias(f"c{i}{i}") for i, d in enumerate(DIMS)])
    first = mad.select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(p)],
                       *[f"c{i}{i}" for i in range(p)], *off)
    second = _moments(_sums(vectors.withColumn("start", F.lit(1))))
    est = stored(_cholesky(first.unionByName(second)), "mcd")
    # The covariance of the nearest share is too small by a known factor.
    q = _chi2_quantile(SUPPORT, p)
    factor = SUPPORT / _chi2_cdf(q, p + 2)
    few = est.count() <= BROADCAST_ROWS         # a row for each group and start, in every step
    last = None
    for _ in range(steps):
        d = vectors.join(F.broadcast(est) if few else est, "g").withColumn(
            "b", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * 64).cast("int"))
        # One pass: sums by distance, of which the nearest are taken together.
        cells = _sums(d, "b")
        before = F.sum("s").over(_by("g", "start").orderBy("b")) - F.col("s")
        total = F.sum("s").over(_by("g", "start"))
        near = cells.withColumns({"_run": before, "_all": total}).where(F.col("_run") < F.lit(SUPPORT) * F.col("_all"))
        names = [c for c in cells.columns if c not in ("g", "start", "b")]
        new = _moments(near.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in names]))
        new = new.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor for i, j in PAIRS})
        est = stored(_cholesky(new), "mcd")
        # Sums of integers: an estimate that stands still is the same to the last bit.
        now = est.agg(F.sum(F.xxhash64(*est.columns).cast("decimal(38,0)"))).first()[0]
        if now == last:
            break
        last = now
    best = est.groupBy("g").agg(F.min(F.struct("logdet", "start")).alias("k"))
    return est.join(small(best), "g").where(F.col("start") == F.col("k.start")) \
        .select("g", *[f"m{i}" for i in range(p)], *[f"c{i}{j}" for i, j in PAIRS])


def shrunk(groups: DataFrame, est: DataFrame, prior: int) -> DataFrame:
    """The estimate of each row (g1, g2, n1, n2) of ``groups``: that of all texts ("*"), the language's
    g2 and the source's g1, each narrower one weighed by its number of texts against ``prior``."""
    p = len(DIMS)
    values = [f"m{i}" for i in range(p)] + [f"c{i}{j}" for i, j in PAIRS]
    at = lambda level, key: est.select(F.col("g").alias(key), *[F.col(v).alias(f"{level}_{v}") for v in values])
    got = groups.withColumn("g0", F.lit("*")).join(small(at("e0", "g0")), "g0") \
        .join(small(at("e2", "g2")), "g2").join(small(at("e1", "g1")), "g1")
    for level, n in (("e2", "n2"), ("e1", "n1")):
        own = F.col(n) / (F.col(n) + prior)
        got = got.withColumns({f"e0_{v}": own * F.col(f"{level}_{v}") + (1 - own) * F.col(f"e0_{v}") for v in values})
    return _cholesky(got.select("g1", *[F.col(f"e0_{v}").alias(v) for v in values]))


def _by(*cols):
    from pyspark.sql import Window
    return Window.partitionBy(*cols)


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          key: list[str] | None = None, prior: int = PRIOR_TEXTS, tail: float = TAIL) -> DataFrame:
    """Return ``key`` columns, the statistics, base_failed, distance and kept for each row."""
    key = ["doc_id"] if key is None else key
    src = df.select(*[F.col(f"`{k}`") for k in key if k not in (text, lang, source)],
                    F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"),
                    F.col(f"`{source}`").alias("_src"),
                    F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_th"))
    stats = statistics(src, "_text")
    n, r = F.col("n_words"), F.col("n_repeat_words")
    stats = stats.withColumn("base_failed", (n < 10) | (100 * r > 20 * n)).select("*", *_vector())
    stats = stored(stats, "quality")
    # Estimates come from the texts that pass the base rules.
    full = F.to_json(F.array(F.coalesce("_lang", F.lit("\x00")), F.coalesce("_src", F.lit("\x00"))))
    lone = F.to_json(F.array(F.coalesce("_lang", F.lit("\x00"))))
    rows = stats.where(~F.col("base_failed")).groupBy("_lang", "_src", *DIMS).agg(F.count("*").alias("n")) \
        .withColumn("g1", full).withColumn("g2", lone)
    rows = stored(rows, "vectors")
    vec = stored(rows.select(F.explode(F.array("g1", "g2", F.lit("*"))).alias("g"), *DIMS, "n")
                 .groupBy("g", *DIMS).agg(F.sum("n").alias("n")), "vectors")
    est = stored(estimates(vec), "estimates")
    n1 = rows.groupBy("g1", "g2").agg(F.sum("n").alias("n1"))
    n2 = stored(n1.groupBy("g2").agg(F.sum("n1").alias("n2")), "languages")
    params = small(stored(shrunk(n1.join(small(n2), "g2"), est, prior), "estimates"))
    limit = _chi2_quantile(1 - tail, len(DIMS))
    out = stats.withColumn("g1", full).join(params, "g1", "left").withColumn("distance", F.sqrt(_distance()))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= math.sqrt(limit)))
    renamed = {"_lang": lang, "_src": source}
    extra = [F.col(a).alias(b) for a, b in renamed.items() if b in key]
    return out.select(*[F.col(f"`{k}`") for k in key if k not in (text, lang, source)], *extra, "_th",
                      "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "distance", "kept")


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
              id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns."""
    verdict = judge(df, text, lang, source, [id_col, lang, source]).where("kept")
    v = verdict.select(F.col(id_col).alias("_i"), F.col(lang).alias("_l"), F.col(source).alias("_s"),
                       F.col("_th").alias("_h")).distinct()
    same = (df[id_col].eqNullSafe(v["_i"]) & df[lang].eqNullSafe(v["_l"]) & df[source].eqNullSafe(v["_s"])
            & (F.xxhash64(F.coalesce(df[text], F.lit(""))) == v["_h"]))
    return df.join(v, same, "left_semi")
