"""Set algebra over integer keys as bitmaps: one row for 32,768 neighbouring keys, 4 KB of bits each.

Keys are put into bitmaps per task before anything moves, so a shuffle carries a bitmap per task and bucket of
keys, however many rows repeat them; sets then meet by bucket and are combined word by word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.operators.skew import skew_join

BUCKET_KEYS = 32_768        # fixed value: keys of a bucket of Spark's bitmap functions
_WORD_BITS = 32


def key_bitmaps(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, bucket, bits): the distinct non-null integer keys of ``df``, for each combination of ``by``."""
    k = F.col(key).cast("long")
    return (df.where(k.isNotNull()).groupBy(*by, F.bitmap_bucket_number(k).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits")))


def _words(bits: Column) -> Column:
    """The bitmap as 1,024 unsigned 32-bit words, first bytes highest."""
    return F.transform(F.regexp_extract_all(F.hex(bits), F.lit("(.{8})"), F.lit(1)), lambda w: F.conv(w, 16, 10).cast("long"))


def _keys(buckets: DataFrame, key: str, others: Sequence[str] = ()) -> DataFrame:
    """The keys whose bits are set in (bucket, words): empty words are dropped before bits are listed."""
    word = buckets.select(*others, "bucket", F.posexplode("words").alias("at", "word")).where(F.col("word") != 0)
    bit = word.select(*others, "bucket", "at", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(_WORD_BITS - 1)), lambda b: F.getbit("word", b) == 1)).alias("bit"))
    # bytes stand highest first in a word, bits lowest first in a byte
    place = F.col("at") * _WORD_BITS + 8 * (3 - F.floor(F.col("bit") / 8)) + F.col("bit") % 8
    value = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BUCKET_KEYS + place + 1).otherwise(F.col("bucket") * BUCKET_KEYS - place)
    return bit.select(*others, value.cast("long").alias(key))


def bitmap_keys(bitmaps: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """The reverse of :func:`key_bitmaps`: one row per key."""
    return _keys(bitmaps.select(*by, "bucket", _words(F.col("bits")).alias("words")), key, by)


def bitmap_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not hold (``EXCEPT`` over one integer column, nulls left out)."""
    gone = key_bitmaps(right, key).select("bucket", F.col("bits").alias("gone"))
    both = key_bitmaps(left, key).join(gone, "bucket", "left")
    words = F.when(F.col("gone").isNull(), _words(F.col("bits"))).otherwise(
        F.zip_with(_words(F.col("bits")), _words(F.col("gone")), lambda a, b: a.bitwiseAND(F.bitwise_not(b))))
    return _keys(both.select("bucket", words.alias("words")), key)


def bitmap_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both hold (``INTERSECT`` over one integer column, nulls left out)."""
    both = key_bitmaps(left, key).unionByName(key_bitmaps(right, key)).groupBy("bucket").agg(
        F.expr("bitmap_and_agg(bits)").alias("bits"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return bitmap_keys(both, key)


def bitmap_members(rows: DataFrame, members: DataFrame, key: str, *, spread_by: Sequence[str]) -> DataFrame:
    """The rows whose key is one of ``members`` (a semi join): each reads one bit of its bucket's bitmap.

    ``spread_by`` tells the rows of a bucket apart, should one bucket hold very many (see ``skew_join``).
    """
    k = F.col(key).cast("long")
    maps = key_bitmaps(members, key).select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    met = skew_join(rows.withColumn("__bucket", F.bitmap_bucket_number(k)), maps, "__bucket", spread_by=spread_by)
    place = F.bitmap_bit_position(k)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def distinct_counts(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(*by, n): number of distinct non-null integer keys for each combination of ``by``."""
    return key_bitmaps(df, key, by).groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))
