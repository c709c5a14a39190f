"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Every query reads whole tables (or data Spark derives from them by a fixed rule). Tables have
no missing values and no duplicate rows, so the null- and duplicate-sensitive queries derive
them by rule, identically in the Spark query and in the SQL:

* ``events``: ``value`` is missing when ``event_id % 7 = 0`` and ``event_type`` when
  ``event_id % 13 = 0``; rows with ``event_id % 50 = 0`` appear twice.
* ``lineitem``: ``l_discount`` is missing when ``l_orderkey % 5 = 0`` and ``l_returnflag``
  when ``l_linenumber = 7``.

Floating results are rounded in both engines (sums of two-decimal money to 2 places, other
statistics to 6) so that the order of additions cannot change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits[c]).alias(c) if c in digits
                       else F.col(f"`{c}`") for c in df.columns])


def events_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    ev = ev.select("event_id", "ts", "user_id",
                   F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("event_type"),
                   F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
                   "props")
    return ev.unionByName(ev.where(F.col("event_id") % 50 == 0))


EVENTS_DIRTY = """
ev AS (SELECT event_id, ts, user_id,
              CASE WHEN event_id % 13 <> 0 THEN event_type END AS event_type,
              CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events),
evd AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE event_id % 50 = 0)
"""


def lineitem_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("l_discount", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount"))) \
             .withColumn("l_returnflag", F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")))


LINEITEM_DIRTY = """
lid AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount, l_tax,
               CASE WHEN l_linenumber <> 7 THEN l_returnflag END AS l_returnflag,
               l_linestatus, l_shipdate FROM lineitem)
"""


# Query groups register themselves on import.
from quarry.plans import q_aggregate, q_profile, q_clean, q_pivot, q_charts, q_cases  # noqa: E402,F401
