"""What the Python workers of bpe hold, and that a task of its last stage needs one of them."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from castlens.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_classes_take_no_object_a_character():
    tracemalloc.start()
    try:
        table = bpe._classes.__wrapped__()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [table[ord(c)] for c in "aé9 \n.中"] == [bpe.LETTER, bpe.LETTER, bpe.DIGIT, bpe.BLANK, bpe.BLANK, bpe.OTHER, bpe.LETTER]
    assert peak < 32 << 20                                # an object a character: 90 MB


@pytest.mark.parametrize("held", [1, 40, 1 << 18])
def test_counts_are_handed_on_some_at_a_time(ranks, monkeypatch, held):
    monkeypatch.setattr(bpe, "HELD_WORDS", held, raising=False)
    monkeypatch.setattr(bpe, "RUN_SIZE", 100)
    texts = [f"zqx{i % 30}k vbn{chr(0x410 + i % 25)}{chr(0x430 + i % 23)}ц the 'tis" for i in range(300)] + [None, ""]
    tokens = bpe.known_tokens(ranks)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 70])], names=["text"]) for i in range(0, len(texts), 70)]
    got, most = Counter(), 0
    for b in bpe._count(tokens)(iter(batches)):
        most = max(most, b.num_rows)
        for r in b.to_pylist():
            got[r["word"]] += r["n"]
    pieces = Counter(x for t in texts for x in regex.findall(public_tokenizers.PATTERN, t or ""))
    assert got == {w: n for w, n in pieces.items() if w.encode() not in ranks}
    assert most <= held + 100                             # a run has fewer words than bytes


@pytest.mark.parametrize("run", [1, 60, 1 << 18])
def test_parts_of_a_text(ranks, monkeypatch, run):
    """Known runs and strangers, the same one several times, next to each other, first, last, alone and in empty texts."""
    monkeypatch.setattr(bpe, "RUN_SIZE", run)
    monkeypatch.setattr(bpe.F, "arrow_udf", lambda f, _: type("Udf", (), {"asNondeterministic": lambda self: f})())
    tokens = bpe.known_tokens(ranks)
    box = lambda v: type("Box", (), {"value": v})()
    texts = ["", None, "zqxvk", "the zqxvk of zqxvk", "zqxvk zqxvk wvbnq", "the of", "zqxvk\nthe", ""]
    got = bpe._known(box([tokens.hashes]), box([(tokens.ids, tokens.before)]))(pa.array(texts, pa.string())).to_pylist()
    for text, r in zip(texts, got, strict=True):
        pieces = regex.findall(public_tokenizers.PATTERN, text or "")
        assert sorted(r["words"]) == sorted({p for p in pieces if p.encode() not in ranks})
        assert all(len(x) == 1 or x and max(x) < bpe.EDGE for x in r["parts"])
        ids = [i for x in r["parts"] for i in x]
        assert [r["words"][i - bpe.EDGE].encode() if i >= bpe.EDGE else i for i in ids] == [ranks.get(p.encode(), p.encode()) for p in pieces]


def test_one_python_worker_a_task(spark, ranks):
    texts = ["zqxvk", "the zqxvk of zqxvk", "zqxvj zqxvi zqxvj", "the of", "", None, "zq" * 100 + " zq" * 100 + "zq" * 100, "the of"]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").repartition(3)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, ranks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.split("\n")) == 1
    rows = got.collect()
    assert len(rows) == 16 and all(r.ids == lib.encode_ordinary(r.text or "") for r in rows)
    assert np.all([type(r.ids) is list for r in rows])
