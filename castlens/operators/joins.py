"""Cutting lineage: checkpoint a table to the shared folder and count it in one job.

Whether a join's side is broadcast is left to AQE, which goes by measured bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from castlens.session import _context, scratch_path


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint ``df`` to the shared checkpoint folder and count it, in one job.

    The checkpoint cuts the lineage: a lost executor re-reads the checkpoint
    files instead of replaying every earlier step. The count is an observed
    metric of the checkpoint job itself (collected in its result stage, where
    each partition's update is applied once), so no second job scans the result.
    """
    out, n, _ = materialize_sum(df, None)
    return out, n


def materialize_sum(df: DataFrame, col: str | None) -> tuple[DataFrame, int, int]:
    """:func:`materialize`, and the sum of an integer column (0 without one or without rows)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(col) if col else F.lit(0), F.lit(0)).alias("s")]
    if not col:
        aggs = aggs[:1]
    if _context(df.sparkSession) is None:   # no observed metrics for commands: count separately
        cp = df.checkpoint(eager=True)
        row = cp.agg(*aggs).first()
        return cp, row["n"], int(row["s"]) if col else 0
    obs = Observation()
    cp = df.observe(obs, *aggs).checkpoint(eager=True)
    got = obs.get
    return cp, int(got["n"]), int(got["s"]) if col else 0


def staged(df: DataFrame, path: str | None = None, **aggs) -> tuple[DataFrame, dict]:
    """Write ``df`` as Parquet to ``path``, or a fresh one in the shared folder, and read it again; ``aggs`` are
    aggregates of its rows, observed by the writing job itself. One job, where a checkpoint takes two; the files' sizes
    tell the planner how large it is."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "staged")
    read = spark.read.schema(df.schema)
    if aggs and _context(spark) is None:
        df.write.parquet(path)
        return read.parquet(path), read.parquet(path).agg(*[a.alias(k) for k, a in aggs.items()]).first().asDict()
    obs = Observation()
    (df.observe(obs, *[a.alias(k) for k, a in aggs.items()]) if aggs else df).write.parquet(path)
    return read.parquet(path), obs.get if aggs else {}


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> str:
    """``df`` as an external table in the shared folder, bucketed and sorted by ``keys``, one file a bucket; its name.

    A join on the keys reads a bucket per task, without a shuffle of this side, and without a sort in a session with
    ``SORTED_BUCKETS``. A lost executor reads the files again.
    """
    name = f"castlens_{uuid.uuid4().hex}"
    path = scratch_path(df.sparkSession, "bucketed")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return name


# files of a bucket are read in their sorted order only with this setting, which is off by default because a bucket
# may have several files; the tables of ``bucketed`` have one
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def bucket_session(spark: SparkSession, buckets: int) -> SparkSession:
    """A session of the same application for joins with :func:`bucketed` tables, the caller's settings untouched.

    Everything there is laid out in ``buckets`` partitions by the join keys, so there is nothing left for adaptive
    re-planning or broadcasts to decide, and a chain of such joins runs as the stages of one job.
    """
    out = spark.newSession()
    for name, value in ((SORTED_BUCKETS, "true"), ("spark.sql.shuffle.partitions", str(buckets)), ("spark.sql.adaptive.enabled", "false"),
                        ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.sources.bucketing.enabled", "true")):
        out.conf.set(name, value)
    return out
