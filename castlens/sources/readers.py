"""Readers for the credit tables and the tutorial-style inputs.

All readers take the path as a parameter (any Hadoop-FS URI works) and return
a lazy DataFrame; with an explicit schema no inference pass is run.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType)

from castlens.constants import HEADER_KEY, NULL_MARKER

# The credit-table layouts of the dumps.
PRINCIPALS_SCHEMA = StructType([
    StructField("tconst", StringType(), True),
    StructField("ordering", IntegerType(), True),
    StructField("nconst", StringType(), True),
    StructField("category", StringType(), True),
    StructField("job", StringType(), True),
    StructField("characters", StringType(), True),
])

RATINGS_SCHEMA = StructType([
    StructField("tconst", StringType(), True),
    StructField("averageRating", DoubleType(), True),
    StructField("numVotes", IntegerType(), True),
])

# The dumps mark nulls with NULL_MARKER and never quote fields.
TSV_OPTIONS = {"sep": "\t", "header": "true", "quote": "", "nullValue": NULL_MARKER,
               "mode": "PERMISSIVE"}


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: StructType | str,
                   sep: str = "\t", header: bool = True, escaped: bool = False, **options) -> DataFrame:
    """Delimited text with a declared schema (no inference pass).

    Tab-separated input is read without quote handling and with ``\\N`` as
    null, so a field that begins with a double quote stays a field and does not
    swallow the following tabs. Rows whose typed fields do not parse become
    nulls in those fields (PERMISSIVE). ``escaped`` undoes the escapes that
    ``write_delimited`` puts into string fields; foreign dumps have none.
    """
    opts = dict(TSV_OPTIONS) if sep == "\t" else {"sep": sep, "mode": "PERMISSIVE"}
    opts["header"] = "true" if header else "false"
    opts.update({k: str(v) for k, v in options.items()})
    df = spark.read.options(**opts).schema(schema).csv(path)
    if escaped:
        df = df.withColumns({f.name: unescape(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, StringType)})
    return df


# Escapes of string fields: backslash first, then what would break a line or a field; \e is
# nothing, and keeps a blank field from making a blank line, which readers skip, and a leading # from quotes.
ESCAPES = (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\0"))


def escape(col: str | Column) -> Column:
    """A string as one field of one line, reversibly: backslash, tab, newline, return and blank strings escaped."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, code in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return F.when(c.rlike(r"^([\x00-\x20]*\z|#)"), F.concat(F.lit("\\e"), out)).otherwise(out)


def unescape(col: str | Column) -> Column:
    """The reverse of :func:`escape`."""
    c = F.col(col) if isinstance(col, str) else col

    def plain(part: Column) -> Column:
        for raw, code in (*ESCAPES, ("", "\\e")):
            part = F.replace(part, F.lit(code), F.lit(raw))
        return part
    return F.when(c.contains("\\"), F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")).otherwise(c)


def read_principals(spark: SparkSession, path: str) -> DataFrame:
    """principals(tconst, ordering, nconst, category, job, characters)."""
    df = read_delimited(spark, path, PRINCIPALS_SCHEMA)
    # A header line repeated inside the data (concatenated dumps) is not a credit.
    return df.where(F.col("tconst").isNull() | (F.col("tconst") != F.lit(HEADER_KEY)))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """ratings(tconst, averageRating, numVotes)."""
    df = read_delimited(spark, path, RATINGS_SCHEMA)
    return df.where(F.col("tconst").isNull() | (F.col("tconst") != F.lit(HEADER_KEY)))


def with_line_order(df: DataFrame, name: str = "line_order") -> DataFrame:
    """Add a column that orders rows as they appear in the input files.

    (file path, block start, row id): a block is read by one task in file
    order and the row id increases within a task, so the struct sorts rows in
    file order — "the last line wins" becomes ``max`` of this column. Works on
    a DataFrame that still reads straight from files (``_metadata`` columns).
    """
    order = F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return df.withColumn(name, order)


def read_csv_inferred(spark: SparkSession, path: str | Sequence[str], sampling_ratio: float = 1.0,
                      **options) -> DataFrame:
    """CSV with a header row and inferred column types.

    Inference costs an extra pass over the sampled fraction of the input; jobs
    that run repeatedly should declare a schema instead (``read_delimited``).
    """
    opts = {"header": "true", "inferSchema": "true", "samplingRatio": str(sampling_ratio)}
    opts.update({k: str(v) for k, v in options.items()})
    return spark.read.options(**opts).csv(path)


def read_csv_clean(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
                   index_name: str = "row_index", **options) -> DataFrame:
    """Read a hand-made CSV and tidy it.

    Handles an unnamed leading index column (Spark names it ``_c0``), quoted
    fields with commas, CRLF line ends and padding spaces around string values.
    """
    opts = {"header": "true", "quote": '"', "escape": '"', "multiLine": "false"}
    opts.update({k: str(v) for k, v in options.items()})
    reader = spark.read.options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    df = reader.csv(path)
    if "_c0" in df.columns:
        df = df.withColumnRenamed("_c0", index_name)
    return trim_strings(df)


def strip_blanks(col: Column) -> Column:
    """Without any whitespace at either end, like Python's ``strip``."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip whitespace (a stray CR among it) around every string column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            out.append(strip_blanks(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def read_json(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
              **options) -> DataFrame:
    """JSON lines; nested objects become structs, arrays become arrays."""
    reader = spark.read.options(**{k: str(v) for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_text_positional(spark: SparkSession, path: str | Sequence[str], fields: dict[str, int],
                         sep: str = "\t", header_field: str | None = None,
                         header_value: str | None = None, header_prefix: str | None = None,
                         strip: bool = False, line_order: str | None = None) -> DataFrame:
    """Schema-less lines split on ``sep``; named fields taken by position.

    ``fields`` maps an output name to a 0-based position. A position past the
    end of a short line gives null. Lines whose ``header_field`` equals
    ``header_value`` are header rows and are dropped wherever they occur; with
    ``header_prefix`` any line starting with that text is dropped instead.
    ``strip`` removes all whitespace around the line before splitting; ``sep`` is
    literal text. ``line_order`` names a column that sorts rows as their lines
    stand in the files (see :func:`with_line_order`).
    """
    line = strip_blanks(F.col("value")) if strip else F.col("value")
    raw = spark.read.text(path)
    if line_order is not None:
        raw = with_line_order(raw, line_order)
    if header_prefix is not None:
        raw = raw.where(~F.col("value").startswith(header_prefix))
    parts = F.split(line, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    df = raw.select(*[F.get(parts, i).alias(name) for name, i in fields.items()], *([line_order] if line_order else []))
    if header_field is not None:
        df = df.where(F.col(header_field).isNull() | (F.col(header_field) != F.lit(header_value)))
    return df


def rows_to_dataframe(spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str) -> DataFrame:
    """Small in-memory rows with a declared schema (e.g. a seed or a lookup)."""
    return spark.createDataFrame(list(rows), schema)
