"""Bounded, documented training samples of labelled documents, and their division into shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castlens.llm.frames import cut

MAX_DOCS = 20_000          # labelled documents that a model is fitted on, those of the smallest id hash
MAX_CHARS = 200_000        # longer texts are not used for fitting (they are scored like all others)
SHARD_DOCS = 2_500         # documents that one task fits on; the shards' weights are averaged


def training_shards(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, *, id_col: str = "doc_id",
                    text_col: str = "text", max_docs: int = MAX_DOCS) -> tuple[DataFrame, int, int]:
    """(shard, label, text, order) of at most ``max_docs`` labelled documents that satisfy ``keep``; shards; documents.

    An id with several label rows is positive if one of them is; rows without id or label are left out, and so are
    labels without a document. The sample is that of the smallest id hashes; an id with several documents brings its
    least text. Documents of the sample whose text is null or longer than MAX_CHARS are not fitted on.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id")).distinct()         # ids only: no text is read to choose the sample
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
           .where(F.col("id").isNotNull() & F.col("label").isNotNull() & keep)
           .groupBy("id").agg(F.max("label").alias("label"))
           .join(ids, "id", "left_semi")
           .orderBy(F.xxhash64("id"), "id").limit(max_docs))
    rows = lab.collect()                                            # at most max_docs rows of two numbers
    lab, n = spark.createDataFrame(rows, lab.schema), len(rows)
    shards = max(1, math.ceil(n / SHARD_DOCS))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= MAX_CHARS)
    got = (text.join(F.broadcast(lab), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
           .select(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), "label", "text",
                   F.xxhash64("id").alias("order")))
    return cut(got, "training"), shards, n


def used_shards(sample: DataFrame) -> int:
    """Shards that hold a document: those whose weights are averaged."""
    return sample.select("shard").distinct().count()
