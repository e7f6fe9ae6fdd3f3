"""Texts move once: only those with a likely partner meet their keys, duplicates share the join's shuffle, and fingerprints stay in place."""

from __future__ import annotations

import re

from castlens.llm import fingerprint, frames, ngramjoin
from tests.llm.helpers import SCHEMA, awkward, rows
from tests.llm.test_similarity import near_corpus


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bitmap_keeps_all_wanted_rows_and_few_others(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("unhex(md5(cast(id as string))) AS tk", "id AS word", "id AS bits")
    keys = docs.where("id % 10 = 0").select("tk")
    want = {r.word for r in docs.where("id % 10 = 0").collect()}
    got = [r.word for r in frames.among(docs, keys.unionByName(keys)).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < 6_000
    assert frames.among(docs, keys.limit(0)).collect() == []
    monkeypatch.setattr(frames, "WORDS", 1)
    assert want <= {r.word for r in frames.among(docs, keys).collect()}


def test_one_shuffle_of_texts_for_join_and_duplicates(spark):
    docs = awkward(spark).unionByName(awkward(spark))
    out = ngramjoin.keep_one(docs)
    whole = [x for x in plan(out).split("Exchange hashpartitioning(")[1:] if x.startswith("__key#")]
    assert whole and not re.search(r"Exchange hashpartitioning\([^)]*__tk", plan(out))
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert {x[0] for x in kept if x[0] is None} == {r.doc_id for r in docs.collect() if r.doc_id is None}


def test_fingerprints_are_not_moved_to_meet_their_links(spark):
    docs = spark.createDataFrame(rows(near_corpus()), SCHEMA)
    out = fingerprint.fingerprints(docs.unionByName(docs.limit(7)))
    top = plan(out).split("MapInArrow")[0]
    assert "Join" not in top and "Exchange" not in top
    got = out.collect()
    linked = {r.tk.hex(): (r.n_links, r.class_id) for r in fingerprint.classes(docs.unionByName(docs.limit(7))).collect()}
    md5 = {(r.doc_id): r.tk for r in docs.selectExpr("doc_id", "md5(coalesce(text, '')) AS tk").collect()}
    assert any(r.n_links for r in got)
    for r in got:
        n, c = linked.get(md5[r.doc_id], (0, r.doc_id))
        assert (r.n_links, r.class_id) == ((n, c) if n else (0, r.doc_id))
