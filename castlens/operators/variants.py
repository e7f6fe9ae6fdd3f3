"""JSON records of changing shape as VARIANT: read once, without a schema and without an inference pass.

A line becomes a binary VARIANT in the task that reads it; fields are then taken by path and type, several
paths for a field that moved between versions of the records. What does not parse keeps its text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record, bad_line): each line of JSON as a VARIANT, or the line itself if it is no JSON; blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != F.lit(""))
    return lines.select(F.try_parse_json("value").alias("record"),
                        F.when(F.try_parse_json("value").isNull(), F.col("value")).alias("bad_line"))


def variant_field(record: str | Column, kind: str, paths: str | Sequence[str]) -> Column:
    """The value at the first of ``paths`` that has one of type ``kind``; null if none has.

    A value of another type is converted if it can be (text ``"1.5"`` to double); otherwise the path counts as
    missing. JSON text inside a string is reached by ``paths`` after ``F.try_parse_json``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    col = F.col(record) if isinstance(record, str) else record
    return F.coalesce(*[F.try_variant_get(col, p, kind) for p in paths])


def variant_columns(df: DataFrame, fields: Mapping[str, tuple[str, str | Sequence[str]]], record: str = "record") -> DataFrame:
    """One typed column for each of ``fields`` (name → (type, paths)); one row per record, bad lines left out."""
    return df.where(F.col(record).isNotNull()).select(
        *[variant_field(record, kind, paths).alias(name) for name, (kind, paths) in fields.items()])


def variant_profile(df: DataFrame, record: str = "record") -> DataFrame:
    """(key, kind, n): how many records hold each top-level field, and as what.

    ``kind`` is the type without its parameters (OBJECT, ARRAY, STRING, DECIMAL, BIGINT, …; VOID for a JSON null).
    Elements of a record that is an array have a null key; a record that is neither has no fields.
    """
    one = df.where(F.col(record).isNotNull()).select(F.col(record).alias("r"))
    fields = one.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("r").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0)
    return fields.groupBy("key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def variant_schema(df: DataFrame, record: str = "record") -> Column:
    """Aggregate: one schema that fits all records (VARIANT where types disagree)."""
    return F.schema_of_variant_agg(F.col(record))
