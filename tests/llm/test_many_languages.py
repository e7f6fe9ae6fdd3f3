"""More languages than a fixed list would hold: every one of them is learned and can be predicted."""

from __future__ import annotations

import random

from castlens.llm import language


def corpus(n):
    """n languages of their own words, later ones with fewer texts; (id, text, lang)."""
    pick = random.Random(3)
    out = []
    for k in range(n):
        vocab = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)]
        for _ in range(2 if k < n // 2 else 1):
            out.append((len(out), " ".join(pick.choice(vocab) for _ in range(40)), f"l{k:03d}"))
    return out


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string, lang string").repartition(4)
    langs, table = language.fit(docs)
    assert langs == [f"l{k:03d}" for k in range(300)] and len(table) == 300
    some = docs.where("lang >= 'l280'")
    got = language.identify(some, docs).select("lang", "language.lang", "language.languages").collect()
    assert len(got) == 20 and all(r[0] == r[1] and r[0] in [x.lang for x in r[2]] for r in got)


def test_blocks_of_words_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(6) + [(90, None, "l001"), (91, "", "l001"), (92, "12 34", "l002")],
                                 "doc_id long, text string, lang string").coalesce(1)
    langs, table = language.fit(docs)
    texts = [r.text for r in docs.collect()]
    import pyarrow as pa
    run = language.identifier(langs, table).func
    whole = run(pa.array(texts, pa.string())).to_pylist()
    for cells in (1, 600, 1 << 22):
        monkeypatch.setattr(language, "CELLS", cells)
        assert run(pa.array(texts, pa.string())).to_pylist() == whole
