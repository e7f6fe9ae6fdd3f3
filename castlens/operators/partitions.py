"""Partition layout: explicit repartitioning and a per-partition size report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repartition(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Hash-partition on ``keys`` into ``n`` partitions (round-robin without keys)."""
    return df.repartition(n, *keys) if keys else df.repartition(n)


def partition_report(df: DataFrame) -> DataFrame:
    """Rows per partition: (partition_id, n_rows), computed on the executors.

    Answers "how many partitions, and how even are they" without pulling the
    data or the partition objects to the driver.
    """
    return (df.select(F.spark_partition_id().alias("partition_id"))
            .groupBy("partition_id").agg(F.count(F.lit(1)).alias("n_rows")))


def partition_summary(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """One row about ``df`` hash-partitioned into ``n``: n_rows over all partitions, n_keys, whether every
    partition number is below ``n``, and whether every key lies in one partition."""
    placed = repartition(df, n, keys).select(F.spark_partition_id().alias("p"), *keys)
    per_key = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    return per_key.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                       F.coalesce(F.max("hi") < F.lit(n), F.lit(True)).alias("in_range"),
                       F.coalesce(F.max(F.col("hi") - F.col("lo")) == 0, F.lit(True)).alias("keys_together"))
