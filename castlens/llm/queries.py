"""One query per operator, each over its whole table, with the digest columns derived from the operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castlens.llm import infill, periodic
from castlens.llm.bpe import decode, encode, load_ranks
from castlens.llm.bytededup import dedup_bytes
from castlens.llm.fingerprint import fingerprints
from castlens.llm.frames import fold, table
from castlens.llm.language import identify
from castlens.llm.linededup import dedup_lines
from castlens.llm.mixing import plan
from castlens.llm.neardup import near_duplicates
from castlens.llm.ngramjoin import jaccard_links
from castlens.llm.quality import score_quality
from castlens.llm.substring import dedup_substrings
from castlens.llm.toxicity import score_toxicity


def sha(col):
    return F.sha2(F.coalesce(col, F.lit("")), 256)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_quality(docs, table(spark, sf_dir, "labels"), fold("id", 3) != 1)
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("quality").alias("score"),
                      (F.col("quality") >= 0.5).cast("int").alias("predicted"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_toxicity(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0)
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity.score").alias("score"),
                      (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
                      F.col("toxicity.offending").alias("offending"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.select("doc_id", "text"), docs.where(fold("doc_id", 5) != 0).select("text", "lang"))
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                      F.col("language.score").alias("score"), F.col("language.languages").alias("languages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", sha(F.col("text")).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    got = plan(docs, entropy=0.95, max_repeats=4.0, budget="tokens", whole=False)
    return got.select(F.col("id").alias("doc_id"), "source", "n_tokens", "pass", "block")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha(F.col("text")).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.plant_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_bytes(docs, earlier_only=False).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_quality,
    op2_embedding_neardup,
    op3_toxicity,
    op4_language,
    op5_substring_dedup,
    op6_bpe,
    op7_mix_sources,
    op8_ngram_jaccard_join,
    op9_fingerprints,
    op10_line_dedup,
    op11_periodic_runs,
    op12_suffix_dedup,
    op13_infill,
)}
