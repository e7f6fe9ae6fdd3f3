"""The driver's tables seen as credit data.

Fixed mapping used by every registered query:

* principals ← lineitem: tconst = l_orderkey, ordering = l_linenumber,
  nconst = l_partkey, category = l_returnflag || l_linestatus
  (six roles: AF AO NF NO RF RO), job = l_returnflag except null when
  l_linestatus = 'O'.
* ratings ← orders: tconst = o_orderkey, averageRating = o_totalprice,
  rated_at = o_orderdate (decides which duplicate rating is the last).

Only Parquet scans with column pruning and filter pushdown are produced here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castlens.constants import DEFAULT_DEPTH, REPLICAS  # noqa: F401  (REPLICAS re-exported)

# This repository's mapping of the credit model onto the driver tables.
ACTING_ROLES = ("AF", "RF")     # the "actor / actress" role set
SINGLE_ROLE = "NO"              # the "producer" role
GRAPH_ROLES = ("RF",)           # roles whose credits form the BFS graph
BFS_SOURCE = 0                  # the search origin (smallest connected person key)
BFS_DEPTH = DEFAULT_DEPTH       # depth limit of the capped search
CHUNK_SIZE = 100_000            # max persons per cast-list row
SMALL_CHUNK = 4                 # the same, small enough that the driver tables have chunked titles
MONEY_SCALE = 2                 # o_totalprice has cents: sums are taken in exact cents

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def role_predicate(roles):
    """Role codes → a predicate on the two base columns, so Parquet gets it as
    pushed filters (a predicate on the concatenated code would not push)."""
    if isinstance(roles, str):
        roles = (roles,)
    cond = None
    for r in roles:
        c = (F.col("l_returnflag") == F.lit(r[0])) & (F.col("l_linestatus") == F.lit(r[1]))
        cond = c if cond is None else (cond | c)
    return cond


def principals(spark: SparkSession, sf_dir: str, roles=None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    if roles is not None:
        li = li.where(role_predicate(roles))
    return li.select(
        F.col("l_orderkey").alias("tconst"),
        F.col("l_linenumber").alias("ordering"),
        F.col("l_partkey").alias("nconst"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("category"),
        F.when(F.col("l_linestatus") == F.lit("O"), F.lit(None).cast("string"))
         .otherwise(F.col("l_returnflag")).alias("job"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("tconst"), F.col("o_totalprice").alias("averageRating"),
                    F.col("o_orderdate").alias("rated_at"))
