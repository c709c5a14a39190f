"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import bitplanes, jaccard, mixing, packing, phrases, pii, quality, secret_scan, tokens, topk, url_lists, vafile, warc
from quarry.llm.common import scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 2, "src4": 2, "src5": 1}
OTHER = 12
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn
    return put


@register("op1_pfair_mix")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    got = mixing.mix(docs, WEIGHTS, OTHER, size=F.col("size"))
    return got.select("doc_id", "source", "size", "mix_source", "mix_start", "mix_block", "mix_slot",
                      "mix_release", "mix_deadline")


@register("op2_secret_ledger")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.report(secret_scan.scan(docs))


@register("op6_rare_first_jaccard")
def op6(spark, sf_dir):
    got = jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text", n=4, num=85, den=100)
    return got.select("doc_id", "n_shingles", F.col("first.id").alias("component_id"), "class_id", "component")


@register("op8_robust_quality")
def op8(spark, sf_dir):
    got = quality.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.round("distance", 6).alias("distance"))


@register("op9_vector_best_fit")
def op9(spark, sf_dir):
    rows = packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER, limit=4096, end_id=1)
    return packing.pack(rows, 4096).withColumnRenamed("id", "doc_id")


@register("op5_segment_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op5(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


@register("op10_warc_index_merge")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # The pages have no fetch times; a rule spreads them over a year.
    when = F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(31_536_000))
    return warc.round_trip(pages, ts=when, min_bytes=0)


@register("op3_contextual_pii")
def op3(spark, sf_dir):
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


# The list: every fifth page enters its host, or its parent domain, at a day given by its id.
URL_SQL = """
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         page_id * 101 % 365 AS day FROM pages),
ev AS (
  SELECT CASE WHEN page_id % 10 = 0 OR len(string_split(host, '.')) < 4 THEN host
              ELSE regexp_replace(host, '^[^.]*[.]', '') END AS pattern,
         CASE WHEN page_id % 15 = 0 THEN 'allow' ELSE 'block' END AS action,
         page_id // 5 % 3 = 2 AS gone, page_id * 37 % 365 AS since
  FROM p WHERE page_id % 5 = 0),
dated AS (SELECT pattern, action, since, bool_or(gone) AS gone FROM ev GROUP BY ALL),
iv AS (SELECT *, lead(since) OVER (PARTITION BY pattern, action ORDER BY since) AS until FROM dated),
hit AS (
  SELECT p.page_id, iv.pattern, iv.action FROM p JOIN iv
    ON NOT iv.gone AND p.day >= iv.since AND (iv.until IS NULL OR p.day < iv.until) AND p.host <> ''
   AND (p.host = iv.pattern OR (ends_with(p.host, '.' || iv.pattern) AND contains(iv.pattern, '.')))),
best AS (
  SELECT page_id, count(*) AS n, arg_max(pattern, length(pattern) * 2 + (action = 'block')::INT) AS pattern,
         arg_max(action, length(pattern) * 2 + (action = 'block')::INT) AS action FROM hit GROUP BY page_id)
SELECT p.page_id, p.host AS list_host, p.day, b.pattern AS list_pattern, coalesce(b.action, 'none') AS list_verdict,
       coalesce(b.n, 0) AS list_active
FROM p LEFT JOIN best b USING (page_id)
"""


@register("op4_temporal_url_lists", URL_SQL)
def op4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 101 % 365).alias("day"))
    host, i = url_lists.host_of(F.col("url")), F.col("page_id")
    whole = (i % 10 == 0) | (F.size(F.split(host, r"\.", -1)) < 4)
    entries = pages.where(i % 5 == 0).select(
        F.when(whole, host).otherwise(F.regexp_replace(host, r"^[^.]*[.]", "")).alias("pattern"),
        F.when(i % 15 == 0, "allow").otherwise("block").alias("action"),
        F.when(F.floor(i / 5) % 3 == 2, "remove").otherwise("add").alias("op"), (i * 37 % 365).alias("at"))
    return url_lists.judge(pages, entries, "url", "day").drop("url")


@register("op7_separator_scan")
def op7(spark, sf_dir):
    folder = scratch(spark, "tokens")
    who = tokens.write(table(spark, sf_dir, "documents"), folder, TOKENIZER, separator=49_407)
    got = tokens.scan(spark, folder, separator=49_407)
    return got.join(who, ["stream", "ordinal"], "left").select(
        F.col("id").alias("doc_id"), "n_tokens", "stream", "ordinal", "closed")


@register("op11_bit_planes")
def op11(spark, sf_dir):
    folder = scratch(spark, "planes")
    bitplanes.write(table(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=2)
    return bitplanes.read(spark, folder).withColumnRenamed("id", "doc_id")


PHRASE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) g(m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cut.lang, cut.phrase, a, k, lf.f AS l, rf.f AS r, ((2000000::HUGEINT * a) // (lf.f::HUGEINT + rf.f))::BIGINT AS score
  FROM cut JOIN f lf ON lf.lang = cut.lang AND lf.phrase = x JOIN f rf ON rf.lang = cut.lang AND rf.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
over AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT *, unnest(range(1, m - n + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS n FROM c WHERE m > 2)) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN over o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.over IS NULL OR 100 * o.over < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::INT AS rank, phrase, a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@register("op12_phrase_fingerprints", PHRASE_SQL)
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def kmeans_sql(dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds one after another; sums are huge integers, floored exactly."""
    out = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1)::INT AS c, v AS m FROM v WHERE vec_id IS NOT NULL
  ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})"""]
    for t in range(rounds + 1):
        out.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, first(vec_id) AS vec_id, first(v) AS v, min(struct_pack(d := d, c := c)) AS b FROM (
    SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v, c{t}) GROUP BY r)""")
        if t < rounds:
            out.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.m, o.m) AS m FROM c{t} o LEFT JOIN (
    SELECT c, list((((s - (s % n + n) % n) // n)::BIGINT) ORDER BY i) AS m FROM (
      SELECT b.c AS c, i, sum(v[i]::HUGEINT)::HUGEINT AS s, count(*) AS n FROM a{t}, range(1, {dim + 1}) g(i) GROUP BY ALL)
    GROUP BY c) n USING (c))""")
    return ",".join(out) + f"""
SELECT vec_id, b.c AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia,
       (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON b.c = c{rounds}.c
"""


@register("op13_va_file_clusters", kmeans_sql())
def op13(spark, sf_dir):
    return vafile.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
