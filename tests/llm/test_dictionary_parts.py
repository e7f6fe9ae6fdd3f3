"""The dictionary of bpe comes to the driver in parts."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import tiktoken

from castlens.llm import bpe


def test_dictionary_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_WORDS", 64)
    monkeypatch.setattr(bpe, "PIECE_WORDS", 10)
    words = {(i * 0x9E3779B97F4A7C15) % (1 << 64): [i % 50000, *range(i % 7)] for i in range(700)}
    rows = [(int(np.uint64(h).view(np.int64)), np.array(ids, np.uint16).tobytes()) for h, ids in words.items()]
    folded = spark.createDataFrame([(h, bytearray(x)) for h, x in rows], "hash long, ids binary").repartition(5)
    hashes, ids, before = bpe._dictionary(folded, 700)
    assert hashes.tolist() == sorted(words)
    assert {int(h): ids[a:b].tolist() for h, a, b in zip(hashes, before[:-1], before[1:], strict=True)} == words
    hashes, ids, before = bpe._dictionary(folded.limit(0), 0)
    assert (len(hashes), len(ids), before.tolist()) == (0, 0, [0])


def test_dictionary_is_not_collected_at_once(spark, monkeypatch):
    """The driver's JVM gets a part of the dictionary at a time, and ids are the library's."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [f"wordlike{i % 90}zq onceonly{i}xv 'tis" for i in range(200)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(type(docs), "toArrow", lambda self: (_ for _ in ()).throw(AssertionError("collected at once")))
    got = {r.doc_id: r.ids for r in bpe.encode(docs, ranks).collect()}
    assert got == {i: lib.encode_ordinary(t or "") for i, t in enumerate(texts)}
