"""DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castlens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps start from it, on any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files of steps whose results are written go when the driver's JVM collects its garbage: ask for it, so
    that the disks hold those of one step and not of all. The last event of a query holds its plan, and so its shuffle
    files, until another query's events come: one without a shuffle goes before."""
    spark.range(1).collect()
    spark._jvm.System.gc()


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


KEY_BITS = 8                 # bits of the bitmap for each key: one in nine of the other rows passes
WORDS = 1 << 20              # its size is bounded: 8 MB of bits


def among(rows: DataFrame, keys: DataFrame, col: str = "tk") -> DataFrame:
    """``rows`` without most of those whose ``col`` is not in ``keys``, and with all others: a bitmap of the keys' hashes
    is broadcast, so that a join that follows moves few rows in vain. With more keys than the bitmap holds, more pass."""
    n = keys.agg(F.approx_count_distinct(col)).first()[0]
    words = min(WORDS, 1 << max(0, n * KEY_BITS // 64).bit_length())
    at = F.pmod(F.xxhash64(col), F.lit(64 * words).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    word, bits = fresh(rows, "word"), fresh(rows, "bits")
    held = keys.groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(bit).alias(bits))
    met = rows.join(F.broadcast(held), F.shiftright(at, 6) == F.col(word))
    return met.where(F.col(bits).bitwiseAND(bit) != 0).drop(word, bits)


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it brings."""
    have = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in have:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python ``rows`` at a time from here on: batches of 10,000 whole texts, Spark's default, take
    tens of MB each in the executor and again in every Python worker. A lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
