"""Adjacency in compressed rows: the sorted keys that belong to an owner, as packed differences in bounded chunks.

A person's neighbours are read through titles: the person's titles, then the casts of those titles. A cast
is stored once and not once per member, so there are never rows for pairs, and a title holding a third of
all persons is so many chunks of bounded size, each of which is read by itself. Compressed rows are made to be written as a table and read many times.

A chunk is a range of member keys: its first key and, for each member, the difference to it in as few whole
bytes as the chunk needs. Fixed width makes any member readable without those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.operators.joins import staged
from castlens.operators.skew import HOT_ROWS, hot_keys, skew_join

CHUNK_KEYS = 4096           # members of a chunk at most


def compressed_rows(edges: DataFrame, owner: str, member: str, *, chunk_keys: int = CHUNK_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(owner, chunk, first, last, n, width, packed): the distinct members of each owner.

    Members are integer keys from 0 to 2^62. Rows with a null owner or member are left out. Chunks are numbered by
    the ranges they cover, in order of their keys but with gaps. An owner of at most ``chunk_keys`` members has one;
    one with n has at most 2n / chunk_keys + 1 ranges that are equally wide, and a range that still holds too many
    is cut into ranges of ``chunk_keys`` key values, so that every chunk is bounded however the keys lie.
    """
    e = (edges.where(F.col(owner).isNotNull() & F.col(member).isNotNull())
         .select(F.col(owner).alias("owner"), F.col(member).cast("long").alias("member")).distinct())
    size = e.groupBy("owner").agg(F.count(F.lit(1)).alias("owner_n"), F.min("member").alias("lo"), F.max("member").alias("hi"))
    e = skew_join(e, size, "owner", spread_by=["member"], hot=hot_keys(edges, owner, hot_rows=hot_rows))
    span = F.greatest(F.lit(float(chunk_keys)), F.ceil((F.col("hi") - F.col("lo") + 1) / (2.0 * F.col("owner_n") / chunk_keys)))
    wide = F.when(F.col("owner_n") <= chunk_keys, F.lit(0)).otherwise(F.floor((F.col("member") - F.col("lo")) / span)).cast("long")
    e, _ = staged(e.select("owner", "member", "owner_n", "lo", wide.alias("wide")))        # the edges are laid out once
    large, small = e.where(F.col("owner_n") > chunk_keys), e.where(F.col("owner_n") <= chunk_keys)
    full = (large.groupBy("owner", "wide").agg(F.count(F.lit(1)).alias("c"))
            .where(F.col("c") > chunk_keys).select("owner", "wide", F.lit(True).alias("full")))
    large = skew_join(large, full, ["owner", "wide"], "left", spread_by=["member"], hot_rows=hot_rows)
    narrow = F.when(F.col("full"), F.floor((F.col("member") - F.col("lo")) / chunk_keys)).otherwise(F.lit(-1)).cast("long")
    e = large.select("owner", "wide", narrow.alias("narrow"), "member").unionByName(
        small.select("owner", "wide", F.lit(-1).cast("long").alias("narrow"), "member"))
    lists = (e.groupBy("owner", "wide", "narrow")
             .agg(F.array_sort(F.collect_list("member")).alias("m"))                       # at most chunk_keys
             .select("owner", F.struct("wide", "narrow").alias("chunk"), "m", F.get("m", F.lit(0)).alias("first"),
                     F.element_at("m", -1).alias("last"), F.size("m").alias("n")))
    lists = lists.withColumn("width", F.greatest(F.lit(1), F.ceil(F.length(F.hex(F.col("last") - F.col("first"))) / 2)).cast("int"))
    packed = F.unhex(F.array_join(F.transform("m", lambda x: F.lpad(F.hex(x - F.col("first")), 2 * F.col("width"), F.lit("0"))), ""))
    return lists.select(F.col("owner").alias(owner), "chunk", "first", "last", "n", "width", packed.alias("packed"))


def _member(at: Column) -> Column:
    """The member at a place of a chunk (0-based)."""
    cell = F.hex(F.substring(F.col("packed"), (at * F.col("width") + 1).cast("int"), F.col("width")))
    return F.col("first") + F.conv(cell, 16, 10).cast("long")


def decoded(chunks: DataFrame, member: str, keep: Sequence[str]) -> DataFrame:
    """One row (*keep, member) for every member of every chunk: each chunk is read by itself."""
    at = chunks.select(*keep, "first", "width", "packed", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    return at.select(*keep, _member(F.col("at")).alias(member))


def members_between(chunks: DataFrame, owner: str, member: str, low: int, high: int) -> DataFrame:
    """(owner, member) for members from ``low`` to ``high``: chunks outside it are not decoded."""
    return decoded(chunks.where((F.col("first") <= high) & (F.col("last") >= low)), member, [owner]).where(
        F.col(member).between(low, high))


def neighbours(titles_of: DataFrame, casts: DataFrame, persons: DataFrame, *, title: str = "title", person: str = "person",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """(person, neighbour, n_titles): whom each of the asked ``persons`` shares a title with, and how many titles.

    ``titles_of`` and ``casts`` are compressed rows of both directions. Only the chunks of the asked persons' titles
    are decoded; the result has a row for every neighbour, so ask for the persons wanted. A person is no neighbour
    of theirs; repeated and unknown persons change nothing.
    """
    asked = persons.select(person).where(F.col(person).isNotNull()).distinct()
    own, _ = staged(decoded(titles_of.join(asked, person, "left_semi"), title, [person]))
    chunk = casts.select(title, "chunk", "first", "n", "width", "packed")
    met = skew_join(own, chunk, title, spread_by=[person], hot_rows=hot_rows)
    return (decoded(met, "neighbour", [person]).where(F.col("neighbour") != F.col(person))
            .groupBy(person, "neighbour").agg(F.count(F.lit(1)).alias("n_titles")))
