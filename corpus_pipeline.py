"""A training corpus from ``documents``: toxicity, line dedup, near-duplicate join, source mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of
documents (the last one: token ids). ``run`` writes each stage's rows as Parquet to the shared folder and
reads them again, so a lost executor costs a task and not the chain. Nulls, empty texts, repeated rows and
empty tables behave as each operator documents; a document without label is scored like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castlens.llm.bpe import decode, encode, load_ranks
from castlens.llm.frames import cut, fold, fresh, table
from castlens.llm.linededup import dedup_lines
from castlens.llm.mixing import mix_sources
from castlens.llm.ngramjoin import keep_one
from castlens.llm.toxicity import score_toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MAX_REPEATS = 1.25          # a small source is read up to 1.25 times for one reading of the largest


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below 0.5, learned from the labels that ``op3_toxicity`` may learn from."""
    col = fresh(docs, "toxicity")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0, out_col=col)
    return scored.where(F.col(col)["score"] < 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents hold, and n_chars to match; every document stays."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join (five words, 0.8)."""
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its tempered weight: every document once, those of small sources some more times."""
    return mix_sources(docs, max_repeats=MAX_REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and whether decoding the ids gives the text again."""
    ranks = load_ranks(public_tokenizers.path(VOCABULARY))
    got = encode(docs.select("doc_id", "lang", "source", "text"), ranks)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return got.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      (decode(F.col("ids"), ranks) == text).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates),
          ("mixing", source_mix), ("bpe", tokens)]

ORACLE_SQL = None           # SQL can't express the trained toxicity stage; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
