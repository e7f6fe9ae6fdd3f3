"""Quality, toxicity and language: held-out accuracy on the tables, and the cases without text, labels or rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from castlens.llm.frames import fold, table
from castlens.llm.language import identify
from castlens.llm.quality import score_quality
from castlens.llm.queries import QUERIES
from castlens.llm.toxicity import score_toxicity
from tests.llm.helpers import awkward, empty

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def held_out(spark, name, label, sf):
    got = QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").where(F.col("held_out") & F.col(label).isNotNull())
    rows = got.select("score", "predicted", label).collect()
    good, bad = ([r.score for r in rows if r[label] == x] for x in (1, 0))
    order = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    return order, sum(r.predicted == r[label] for r in rows) / len(rows), rows


def test_quality_held_out(spark):
    order, right, _ = held_out(spark, "op1_quality", "quality", SMALL)
    assert order > 0.98 and right > 0.95


def test_toxicity_held_out(spark):
    order, right, rows = held_out(spark, "op3_toxicity", "toxic", SF)
    assert order > 0.95 and right > 0.93
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) < 0.02 * len(clean)


def test_language_held_out(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "lang", "text")
    rows = QUERIES["op4_language"](spark, SMALL).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows if r.held_out) > 0.98 * sum(r.held_out for r in rows)


def test_folds(spark):
    ids = spark.createDataFrame([(None,), (0,), (1,)], "doc_id long")
    import zlib
    assert [r[0] for r in ids.select(fold("doc_id", 5)).collect()] == [None, zlib.crc32(b"0") % 5, zlib.crc32(b"1") % 5]


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_scores_of_awkward_texts(spark, score):
    docs = awkward(spark)
    some = labels(spark, [(i, i % 2, i % 2) for i in range(14)] + [(3, 1, None), (None, 1, 1), (4, None, None)])
    for lab in (some, labels(spark, []), some.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))):
        got = score(docs, lab, F.lit(True), out_col="out")
        assert got.columns == [*docs.columns, "out"]
        rows = got.select("text", F.col("out.score" if score is score_toxicity else "out").alias("s")).collect()
        assert len(rows) == docs.count() and all(0.0 <= r.s <= 1.0 for r in rows)
        by_text = {}
        for r in rows:
            assert by_text.setdefault(r.text, r.s) == r.s
        assert by_text[None] == by_text[""]
    assert score(empty(spark), some, F.lit(True)).collect() == []


def test_offending_sentences_are_located(spark):
    clean = ["The day is fine. We walk home now. All is well!", "Rain again today? Bring a coat. It is cold."]
    bad = "The day is fine. You are a vilewordish thing! We walk home now."
    docs = spark.createDataFrame([(i, bad if i % 3 == 0 else clean[i % 2]) for i in range(240)], "doc_id long, text string")
    got = score_toxicity(docs, labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(240)]), F.lit(True), out_col="t")
    for r in got.collect():
        assert (r.t.score >= 0.5) == (r.text == bad)
        spots = [r.text[s.start:s.end] for s in r.t.offending]
        assert spots == (["You are a vilewordish thing"] if r.text == bad else [])


def test_languages_of_a_mixed_text(spark):
    learn = spark.createDataFrame([("the cat and the dog went home with the boy " * 5, "xx"), ("der hund und die katze gingen nach hause mit dem " * 5, "yy"),
                                   ("zzz", None), (None, "xx")], "text string, lang string")
    docs = spark.createDataFrame([(0, "the dog and the cat"), (1, "der hund und die katze"), (2, "the cat and the dog went home " * 20 + "der hund und die katze gingen nach hause " * 12),
                                  (3, None), (4, "123 !! 45"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.language for r in identify(docs, learn).collect()}
    assert got[0].lang == "xx" and got[1].lang == "yy" and len(got[0].languages) == 1
    assert got[2].lang == "xx" and {x.lang for x in got[2].languages} == {"xx", "yy"} and 0.5 < got[2].score < 0.75
    assert all(got[i].lang == "und" and got[i].score == 0 for i in (3, 4, 5))
    nothing = identify(docs, learn.where("lang = 'none'"))
    assert all(r.language.lang == "und" for r in nothing.collect())
    assert identify(awkward(spark), learn).count() == awkward(spark).count() and identify(empty(spark), learn).collect() == []
