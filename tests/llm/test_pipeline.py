"""The pipeline's stages, each on its own input, and the queries' columns."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from castlens.llm.frames import cut, table
from castlens.llm.queries import QUERIES
from tests.conftest import SF_SMOKE
from tests.llm.helpers import awkward, empty, jaccard, shingles
from tests.llm.test_lines_and_windows import plain_lines


def test_stages_on_the_smoke_tables(spark):
    docs = table(spark, SF_SMOKE, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, SF_SMOKE), name)
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == before.columns
        if name == "toxicity":
            score = {r.doc_id: r.score for r in QUERIES["op3_toxicity"](spark, SF_SMOKE).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, s in score.items() if s < 0.5)
        if name == "line_dedup":
            exp = plain_lines([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(repr((r.doc_id, r.text)) for r in docs.collect()) == sorted(repr(eval(x)[:2]) for x in exp)  # noqa: S307
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "ngram_jaccard":
            kept = {r.doc_id: shingles(r.text) for r in docs.collect()}
            for a, s in kept.items():
                assert not any(a < b and jaccard(s, t) >= 0.8 for b, t in kept.items())
            assert len(kept) == docs.count() < before.count()
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert seen["bpe"].where("round_trip").count() == seen["mixing"].count() > 0


def test_stages_on_awkward_and_empty_documents(spark):
    for make in (awkward, empty):
        docs = make(spark)
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF_SMOKE), f"{name}_{n}")
            assert (docs.count() > 0) == (n > 0)


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 14))
