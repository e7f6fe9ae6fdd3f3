"""Links and classes of the fingerprints against all pairs in plain Python."""

from __future__ import annotations

import hashlib
import random

from castlens.llm import fingerprint
from tests.llm.helpers import SCHEMA, awkward, empty, jaccard, rows, shingles
from tests.llm.test_similarity import near_corpus, plain_links


def check_links(docs):
    got = fingerprint.fingerprints(docs).collect()
    assert sorted(repr((r.doc_id, r.n_links, r.class_id)) for r in got) == plain_links([(r.doc_id, r.text) for r in docs.collect()])


def test_links_and_classes_of_every_document(spark, monkeypatch):
    check_links(awkward(spark))
    docs = spark.createDataFrame(rows(near_corpus()), SCHEMA).repartition(5)
    check_links(docs)
    monkeypatch.setattr(fingerprint, "TILE", 7)
    check_links(docs)
    assert fingerprint.fingerprints(empty(spark)).collect() == []


def test_members_far_from_the_least_of_a_band_are_linked(spark):
    """A large group in which many pairs, but not all, are similar: every link counts, not only those to one member."""
    pick = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        w = list(base)
        for k in pick.sample(range(100), pick.randint(1, 3)):
            w[k] = f"n{pick.random()}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    exp = {hashlib.md5(t.encode()).hexdigest(): sum(jaccard(a, b) >= 0.8 for b in sets) - 1 for t, a in zip(texts, sets, strict=True)}
    assert 0 < sum(exp.values()) < 60 * 59
    got = fingerprint.classes(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert {r.tk.hex(): r.n_links for r in got} == exp
    best = {r.tk: r.jaccard for r in fingerprint.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    near = {hashlib.md5(t.encode()).hexdigest(): max(jaccard(a, b) for u, b in zip(texts, sets, strict=True) if u != t) for t, a in zip(texts, sets, strict=True)}
    assert best == {k: v for k, v in near.items() if v >= 0.8}
