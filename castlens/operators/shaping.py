"""Reshaping operators: rename/add/drop, derived columns, unions, replication,
set difference and ordered subsets. All are narrow (no shuffle) except the
set difference and the ordered subset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.functions.columns import concat_key, midpoint


def rename_add_drop(df: DataFrame, renames: Mapping[str, str] | None = None,
                    constants: Mapping[str, object] | None = None,
                    drop: Sequence[str] = (), null_columns: Mapping[str, str] | None = None) -> DataFrame:
    """Rename columns, add constant and typed-null columns, drop columns.

    One projection: Catalyst collapses the chain, so the cost is the same as a
    single ``select``. ``null_columns`` maps a name to a type so a null column
    never has the untyped ``void`` type (which cannot be written).
    """
    out = df
    if renames:
        out = out.withColumnsRenamed(dict(renames))
    add: dict[str, Column] = {}
    for name, value in (constants or {}).items():
        add[name] = F.lit(value)
    for name, typ in (null_columns or {}).items():
        add[name] = F.lit(None).cast(typ)
    if add:
        out = out.withColumns(add)
    if drop:
        out = out.drop(*drop)
    return out


def with_key(df: DataFrame, name: str, *parts: str | Column, sep: str | None = None) -> DataFrame:
    """Add a key column concatenated from columns/literals (null if any part is null)."""
    return df.withColumn(name, concat_key(*parts, sep=sep))


def with_midpoint(df: DataFrame, low: str, high: str, out: str = "avg",
                  copies: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``out = (low + high) / 2`` and copies of existing columns."""
    cols = {out: midpoint(low, high)}
    for new, old in (copies or {}).items():
        cols[new] = F.col(old)
    return df.withColumns(cols)


def with_sql_columns(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Add columns given as SQL expressions, e.g. ``{"mid": "(low + high) / 2"}``.

    Parsed by Spark into ordinary expressions (same plan as the Column API).
    """
    return df.withColumns({name: F.expr(e) for name, e in exprs.items()})


def align_types(dfs: Sequence[DataFrame], to_string: Sequence[str] = ()) -> list[DataFrame]:
    """Cast ``to_string`` columns to string in every input so a union cannot
    widen them to a number (a zip such as ``27701-12`` would then fail)."""
    out = []
    for d in dfs:
        out.append(d.withColumns({c: F.col(c).cast("string") for c in to_string if c in d.columns}))
    return out


def union_by_name(dfs: Sequence[DataFrame], allow_missing: bool = False,
                  to_string: Sequence[str] = ()) -> DataFrame:
    """Union by column name (order ignored). Missing columns are an error
    unless ``allow_missing``; then they are filled with nulls."""
    parts = align_types(dfs, to_string)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=allow_missing)
    return out


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Positional union keeping every row."""
    out = dfs[0]
    for p in dfs[1:]:
        out = out.union(p)
    return out


def replicate(df: DataFrame, copies: int, copy_col: str | None = None) -> DataFrame:
    """Every row ``copies`` times (the "union a table with itself n times" step).

    A generator per row keeps the plan one node deep whatever ``copies`` is,
    instead of a union tree with ``copies`` scans of the input.
    """
    rep = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    if copy_col:
        return rep.withColumnRenamed("_copy", copy_col)
    return rep.drop("_copy")


def set_difference(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None,
                   distinct: bool = True) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``.

    ``distinct=True`` is SQL ``EXCEPT`` (set); ``False`` keeps left's duplicates
    (anti join). ``on`` defaults to all columns; nulls equal nulls, as in ``EXCEPT``.
    Both sides are made distinct before they meet, so a key with very many rows
    is one row per task in the shuffle.
    """
    cols = list(on or left.columns)
    l = (left.distinct() if distinct else left).alias("l")
    r = right.select(*cols).distinct().alias("r")
    same = reduce(and_, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in cols])
    return l.join(r, same, "left_anti")


def first_n(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows in a declared order (Spark has no file order).

    Planned as a per-task top-n and one merge of at most tasks × n rows.
    """
    return df.orderBy(*order_by).limit(n)
