"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). The ledger, a folder of
Parquet files, records which (blob, rule version) pairs were scanned and what was found. A scan
reads only blobs with an unseen pair, applies only the unseen rules to each, appends to the
ledger, and joins the findings back to all paths that hold the blob.

Everything is DataFrame expressions. Copies collapse to one blob before any rule runs (partial
aggregation first, so a hot blob arrives as one row per map task); only blobs with findings are
joined back, on small rows, and Spark splits a hot blob's paths.

Defined cases: a null text is the empty blob; repeated rows each get their findings; an empty
table gives an empty result; a rule whose version rises is scanned again, and only its latest
findings count; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import count_kind, digest, fresh, scratch, spans, text_of

FOUND = "array<struct<start:int,end:int,match:string,kind:string>>"
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the shortest match, and for ``group`` the shortest group 1."""
    kind: str
    pattern: str
    version: int = 1
    min_length: int = 0
    min_group: int = 0

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"

    def find(self, text: Column) -> Column:
        def keep(m):
            ok = F.length(m) >= self.min_length
            if self.min_group:
                ok = ok & (F.length(F.regexp_extract(m, self.pattern, 1)) >= self.min_group)
            return ok
        return spans(text, self.pattern, self.kind, keep)


BASE = (Rule("assign", ASSIGN, min_group=6),
        Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
        # a run of 24 or more is found whole: a match starts where its run starts
        Rule("hex", r"[0-9a-f]{24,}"))
# Kinds beyond the base ones.
EXTRA = (Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
         Rule("pat", r"gh[pousr]_[A-Za-z0-9]+", min_length=40),
         Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"))
RULES = BASE + EXTRA


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """blob, tags (scanned rule versions), found: one row per scan of a blob."""
    schema = f"blob string, tags array<string>, found {FOUND}"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def update(versions: DataFrame, ledger: str, rules=RULES, text: str = "text") -> None:
    """Scan the unseen (blob, rule version) pairs of ``versions`` and append them to the ledger."""
    spark = versions.sparkSession
    t = text_of(f"`{text}`")
    blobs = versions.select(F.sha2(t, 256).alias("blob"), t.alias("body")) \
        .groupBy("blob").agg(F.first("body").alias("body"))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("tags"))).alias("seen"))
    want = F.array(*[F.lit(r.tag) for r in rules])
    todo = blobs.join(seen, "blob", "left").withColumn(
        "tags", F.array_except(want, F.coalesce("seen", F.array().cast("array<string>"))))
    todo = todo.where(F.size("tags") > 0)
    none = F.array().cast(FOUND)
    found = F.concat(*[F.when(F.array_contains("tags", r.tag), r.find(F.col("body"))).otherwise(none)
                       for r in rules])
    todo.select("blob", "tags", found.alias("found")).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules=RULES, text: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every version with its blob and the ledger's findings of the rules."""
    spark = versions.sparkSession
    keep = ["doc_id"] if keep is None else keep
    want = F.array(*[F.lit(r.tag) for r in rules])
    # A finding counts if the row that holds it scanned the present version of its rule.
    log = read_ledger(spark, ledger).where(F.size("found") > 0)
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.tag))])
    now = F.filter("found", lambda s: F.array_contains(F.array_intersect("tags", want), version[s["kind"]]))
    hits = log.select("blob", now.alias("found")).where(F.size("found") > 0) \
        .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    paths = versions.select(*[F.col(f"`{k}`") for k in keep],
                            F.sha2(text_of(f"`{text}`"), 256).alias("blob"))
    return paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


def scan(versions: DataFrame, ledger: str | None = None, rules=RULES, text: str = "text",
         keep: list[str] | None = None) -> DataFrame:
    """Bring the ledger up to date and return all versions' findings."""
    ledger = ledger or scratch(versions.sparkSession, "ledger")
    update(versions, ledger, rules, text)
    return findings(versions, ledger, rules, text, keep)


def report(found: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """Counts and span digests per row of ``scan``."""
    f, kinds = F.col("found"), [r.kind for r in base]
    return found.select(
        *[c for c in found.columns if c not in ("found", "blob")],
        *[count_kind(f, k).alias(f"n_{k}") for k in kinds],
        F.sha2(digest(f, kinds), 256).alias("base_sha256"),
        digest(f, [r.kind for r in rules]).alias("spans"), "blob")


def redact(df: DataFrame, text: str = "text", rules=RULES, mark: str = "[secret]",
           ledger: str | None = None) -> DataFrame:
    """All rows and columns, with every found span replaced by ``mark``.

    Only texts with findings are rewritten; a null text stays null. Overlapping spans are
    replaced as one.
    """
    ledger = ledger or scratch(df.sparkSession, "ledger")
    update(df, ledger, rules, text)
    hits = findings(df, ledger, rules, text, []).where(F.size("found") > 0).distinct()
    blob, cut = fresh(df, "_blob"), fresh(df, "_cut")
    hits = hits.select(F.col("blob").alias(blob), F.array_sort(F.transform(
        "found", lambda s: F.struct(s["start"], s["end"]))).alias(cut))
    key = F.sha2(text_of(f"`{text}`"), 256)
    got = df.join(hits, key == F.col(blob), "left")
    body = F.col(f"`{text}`")
    done = F.aggregate(
        cut, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
            F.when(s["start"] >= a["at"], F.concat(
                a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    new = F.when(F.col(cut).isNull(), body).otherwise(done)
    return got.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
