"""Joins that stay even when one key holds a large share of the rows, also where the other side is an aggregate.

Spark splits a skewed join by itself only between two plain shuffles; when one side is an aggregate of the join
key its layout is fixed and the hot key stays in one task. Here the hot keys are found first, by a mergeable
frequent-items sketch (one small state per task, no shuffle of rows), and only they are split: each of their
rows gets one of several salts, and the other side's few rows of such a key are repeated once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000        # rows of a key that one task may take; a key with more gets a salt for every so many
TRACKED = 1 << 16           # keys a sketch tracks: every key with more than about 4/TRACKED of the rows is found
HOT_KEYS = 10_000           # hot keys at most, the most frequent ones: bounds what is broadcast to 200 KB or so


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(rows: DataFrame, keys: str | Sequence[str], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(hot_key, salts): hashes of the keys with more than ``hot_rows`` rows and the number of salts each gets.

    Lazy, and at most HOT_KEYS rows. Counts are the sketch's lower bounds; they decide the layout of a join and
    never its rows. Rows with a null key join nothing and are not counted. Without hot keys there are no rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    top = rows.dropna(subset=keys).select(key_hash(keys).alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_KEYS}, {TRACKED})").alias("top"))
    return (top.select(F.explode("top").alias("x")).where(F.col("x.count") > hot_rows)
            .select(F.col("x.item").alias("hot_key"), F.ceil(F.col("x.count") / F.lit(hot_rows)).cast("int").alias("salts")))


def _with_salts(df: DataFrame, keys: Sequence[str], hot: DataFrame, name: str) -> DataFrame:
    """``df`` with the number of salts of its key (1 for an ordinary one); the hot table is broadcast (HOT_KEYS rows)."""
    found = hot.select(F.col("hot_key").alias(f"{name}_key"), F.col("salts").alias(f"{name}_n"))
    joined = df.join(F.broadcast(found), key_hash(keys) == F.col(f"{name}_key"), "left")
    return joined.withColumn(f"{name}_n", F.coalesce(f"{name}_n", F.lit(1))).drop(f"{name}_key")


def _unused(*frames: DataFrame) -> str:
    have = {c.lower() for f in frames for c in f.columns}
    name = "salt"
    while any(c.startswith(name) for c in have):
        name = f"_{name}"
    return name


def with_salt(rows: DataFrame, keys: Sequence[str], hot: DataFrame, spread_by: Sequence[str], salt: str = "salt") -> DataFrame:
    """``rows`` with one salt each, a hash of the ``spread_by`` columns: the same on every run of a task."""
    out = _with_salts(rows, keys, hot, salt)
    return out.withColumn(salt, F.pmod(F.xxhash64(F.lit(salt), *[F.col(c) for c in spread_by]), F.col(f"{salt}_n")).cast("int")).drop(f"{salt}_n")


def per_salt(rows: DataFrame, keys: Sequence[str], hot: DataFrame, salt: str = "salt") -> DataFrame:
    """``rows`` once for every salt of their key."""
    out = _with_salts(rows, keys, hot, salt)
    return out.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(f"{salt}_n") - 1))).drop(f"{salt}_n")


def skew_join(rows: DataFrame, other: DataFrame, keys: str | Sequence[str], how: str = "inner", *, spread_by: Sequence[str],
              hot: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows.join(other, keys, how)`` with the hot keys of ``rows`` split over several tasks.

    ``how`` is inner, left, left_semi or left_anti: each row of ``rows`` has one salt and meets all rows of ``other``
    with its key there, so the result is that of the plain join. ``spread_by`` names columns of ``rows`` that tell the rows
    of a key apart. ``hot`` comes from :func:`hot_keys`, of ``rows`` or of a table it is derived from. ``other`` should
    have few rows a key (an aggregate, a lookup table), as those of a hot key are repeated.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = hot_keys(rows, keys, hot_rows=hot_rows) if hot is None else hot
    salt = _unused(rows, other)
    left = with_salt(rows, keys, hot, spread_by, salt)
    return left.join(per_salt(other, keys, hot, salt), [*keys, salt], how).drop(salt)
