"""Corpus pipeline: quality rules, near duplicates, secrets, mixing and packing of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import jaccard, mixing, packing, quality, secret_scan
from quarry.llm.common import scratch
from quarry.llm.queries import OTHER, TOKENIZER, WEIGHTS

# The stages hold regular expressions with offsets, an iterative estimate, a tokenizer and a
# schedule, which SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return jaccard.keep_one(docs, "doc_id", "text", n=5, num=4, den=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are laid out in the order of the mixture."""
    return mixing.mixed(docs, WEIGHTS, OTHER)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset, in the order of the mixture. The
    documents carry their columns only, so their slots are worked out again from the same rows and
    weights, however the rows are stored."""
    placed = mixing.mix(docs, WEIGHTS, OTHER)
    start, slot = placed.columns[-5], placed.columns[-3]        # the added columns come last
    rows = packing.pieces(placed, TOKENIZER, limit=4096, end_id=1, keep=[slot, start])
    return packing.pack(rows, 4096, order=(slot, start)).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
