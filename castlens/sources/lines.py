"""Lines of text files by their place: numbers, the first n in file order, and a quarantine for lines that don't parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.window import Window

from castlens.sources.readers import TSV_OPTIONS


def number_lines(spark: SparkSession, path: str | Sequence[str], *, first: int | None = None) -> DataFrame:
    """(file, line, line_no, value): every line of the files with its number in its file (from 1) and in all of them
    (from 0; files in order of their paths), or the ``first`` lines only.

    A block of a file is read by one task in order, so a line's number is the number of lines before its block, plus its
    place in it. A first pass counts the lines of each block, without their text; running sums over the blocks (a row for
    each, not for each line) give where they begin, and the second pass adds places up. Nothing is sorted or shuffled but the
    blocks' counts, or the lines by block where there are too many blocks to broadcast. With ``first``, only blocks that begin
    before it are joined.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("at"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"all_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
                                 "file_before": F.coalesce(F.sum("n").over(inside), F.lit(0))}).drop("n")
    if first is not None:
        blocks = blocks.where(F.col("all_before") < first)
    place = F.col("row") - F.col("at")
    out = lines.join(blocks, ["file", "block"]).select(
        "file", (F.col("file_before") + place + 1).alias("line"), (F.col("all_before") + place).alias("line_no"), "value")
    return out if first is None else out.where(F.col("line_no") < first)


def read_quarantined(spark: SparkSession, path: str | Sequence[str], schema: StructType, sep: str = "\t",
                     header: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Delimited lines with a declared schema, as two tables: the rows that parse, and the lines that don't.

    The second holds file, line (its number there, from 1) and value: lines with too few or too many fields, or with a field
    that is not of its type; nothing becomes null silently. With ``header``, lines that repeat the field names are neither.
    Tab-separated input is read without quotes and with the dumps' null marker, as ``read_delimited`` does.
    """
    bad = "__unparsed"
    opts = {**(TSV_OPTIONS if sep == "\t" else {"sep": sep, "mode": "PERMISSIVE"}), **{k: str(v) for k, v in options.items()},
            "columnNameOfCorruptRecord": bad}
    opts.pop("header", None)
    full = StructType([*schema.fields]).add(bad, StringType())
    lines = number_lines(spark, path)
    if header:
        lines = lines.where(F.col("value") != F.lit(sep.join(schema.fieldNames())))
    parsed = lines.where(F.col("value") != "").withColumn("row", F.from_csv("value", full.toDDL(), opts))
    good = parsed.where(F.col(f"row.{bad}").isNull()).select(*[F.col(f"row.`{c}`") for c in schema.fieldNames()])
    return good, parsed.where(F.col(f"row.{bad}").isNotNull()).select("file", "line", "value")
