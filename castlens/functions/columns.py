"""Column expressions built only from Spark's built-in functions (JVM side,
inside whole-stage codegen); no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castlens.constants import WORD_SEPARATORS  # re-exported


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat_key(*parts: str | Column, sep: str | None = None) -> Column:
    """Concatenate columns and literal separators; null if any part is null.

    Strings in ``parts`` are column names. With ``sep`` the separator is put
    between consecutive parts. Unlike ``concat_ws`` a null part is not skipped:
    a key with a missing component must not look like a valid key.
    """
    cols: list[Column] = []
    for i, p in enumerate(parts):
        if sep is not None and i:
            cols.append(F.lit(sep))
        cols.append(_c(p).cast("string"))
    return F.concat(*cols)


def split_get(col: str | Column, pattern: str, index: int) -> Column:
    """Element ``index`` (0-based) of ``col`` split by regex ``pattern``; null when absent."""
    return F.get(F.split(_c(col), pattern, -1), index)


def array_get(col: str | Column, index: int) -> Column:
    """Element ``index`` (0-based) of an array column; null when out of range."""
    return F.get(_c(col), index)


# A decimal number with optional sign, fraction and exponent; blanks around it are allowed. Fixed value.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def safe_double(col: str | Column) -> Column:
    """Text → double; text that is no decimal number becomes null instead of failing the job.

    Type suffixes (``1d``), digit separators (``1_0``), hex, ``NaN`` and infinities are not numbers here: a
    NaN would spread through every average it enters.
    """
    c = _c(col)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def midpoint(a: str | Column, b: str | Column) -> Column:
    """``(a + b) / 2`` as a double (also for integer inputs)."""
    return (_c(a) + _c(b)) / F.lit(2)


def word_tokens(text: str | Column, pattern: str = WORD_SEPARATORS) -> Column:
    """Array of the tokens of ``text`` split on ``pattern``; it may hold empty ones at the ends."""
    return F.split(_c(text), pattern, -1)


def stable_bucket(col: str | Column, n_buckets: Column | int) -> Column:
    """Deterministic bucket in ``[0, n_buckets)`` from the MD5 of the value's text.

    Same input, same bucket on every executor and every retry, so work split
    by it is reproducible after a lost task.
    """
    h = F.conv(F.substring(F.md5(_c(col).cast("string")), 1, 8), 16, 10).cast("bigint")
    n = n_buckets if isinstance(n_buckets, Column) else F.lit(n_buckets)
    return F.pmod(h, n.cast("bigint"))
