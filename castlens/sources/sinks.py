"""Distributed writers. Nothing here collects rows to the driver.

Each writer takes the output folder as a parameter; with ``mode="overwrite"``
a previous result in that folder is replaced, which is what a rerun of a job
needs (the old output would otherwise make the write fail).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from castlens.constants import LIST_ROW, NULL_MARKER, TUPLE_ROW
from castlens.sources.readers import escape, read_delimited

# No quoting, nothing trimmed: what a field holds is what is written.
PLAIN_TSV = {"sep": "\t", "quote": "", "nullValue": NULL_MARKER, "emptyValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def row_text(cols: Sequence[str | Column], open_: str = "[", close: str = "]", sep: str = ",") -> Column:
    """One text line per row in the ``[a,b]`` / ``(a,b)`` style of a printed row.

    Nulls print as ``null``.
    """
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null"))
             for c in cols]
    return F.concat(F.lit(open_), F.concat_ws(sep, *parts), F.lit(close))


def write_text_rows(df: DataFrame, path: str, cols: Sequence[str] | None = None, style: str = "list",
                    mode: str = "overwrite", sort_by: Sequence[Column] | None = None) -> None:
    """Write every row as one line of text (``list`` → ``[a,b]``, ``tuple`` → ``(a,b)``).

    With ``sort_by`` the rows are range-partitioned and sorted first, so the part
    files concatenated in name order hold the global order.
    """
    cols = list(cols or df.columns)
    o, sep, c = LIST_ROW if style == "list" else TUPLE_ROW
    out = df
    if sort_by is not None:
        out = out.orderBy(*sort_by)
    out.select(row_text(cols, o, c, sep).alias("value")).write.mode(mode).text(path)


def json_text(col: Column) -> Column:
    """The JSON text of any value (string → quoted, number, array, struct)."""
    return F.regexp_extract(F.to_json(F.array(col)), r"^\[(.*)\]$", 1)


def write_keyvalue(df: DataFrame, path: str, key: str, value: str | Column, mode: str = "overwrite",
                   json_value: bool = False, json: bool = False) -> None:
    """``key<TAB>value`` lines.

    ``json_value`` JSON-encodes a struct/array/map value; ``json`` encodes both
    key and value as JSON text (``"nm0000001"<TAB>[3]``), the layout of
    line-oriented job output. Otherwise text is escaped like in
    :func:`write_delimited`, so any key reads back as it was.
    """
    v = value if isinstance(value, Column) else F.col(value)
    k = F.col(key)
    if json:
        k, v = json_text(k), json_text(v)
    elif json_value:
        v = F.to_json(v)
    k, v = k.cast("string"), v.cast("string")
    if not json:
        k, v = escape(k), v if json_value else escape(v)
    (df.select(k.alias("k"), v.alias("v")).write.mode(mode).options(**PLAIN_TSV).option("header", "false").csv(path))


def read_keyvalue(spark: SparkSession, path: str, schema: StructType | str, escaped: bool = True) -> DataFrame:
    return read_delimited(spark, path, schema, sep="\t", header=False, escaped=escaped)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True,
                    mode: str = "overwrite", **options) -> None:
    """Delimited text. Tab-separated: the dump's own layout (``\\N`` nulls, no quoting), string fields escaped so
    that ``read_delimited(..., escaped=True)`` gives back every value; other separators: quoted CSV."""
    if sep == "\t":
        df = df.withColumns({f.name: escape(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, StringType)})
    w = df.write.mode(mode).option("sep", sep).option("header", "true" if header else "false")
    if sep == "\t":
        w = w.options(**PLAIN_TSV)
    for k, v in options.items():
        w = w.option(k, str(v))
    w.csv(path)


def stage_to_parquet(spark: SparkSession, raw_path: str, schema: StructType | str, out_path: str,
                     mode: str = "overwrite", partition_by: Sequence[str] | None = None,
                     num_files: int | None = None, header_key: str | None = None,
                     **read_options) -> DataFrame:
    """Ingest step: raw delimited dump → typed Parquet, then read the Parquet back.

    Later jobs then get column pruning and predicate pushdown from Parquet
    instead of re-parsing text. A gzip-compressed dump is not splittable (one
    task reads a whole file); ``num_files`` round-robins the rows into that
    many output files so every later read is spread over the cluster. With
    ``header_key``, header lines repeated inside the dump (first field equal to
    it) are dropped wherever they occur.
    """
    df = read_delimited(spark, raw_path, schema, **read_options)
    if header_key is not None:
        first = F.col(df.columns[0])
        df = df.where(first.isNull() | (first.cast("string") != F.lit(header_key)))
    if num_files:
        df = df.repartition(num_files)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out_path)
    return spark.read.parquet(out_path)
