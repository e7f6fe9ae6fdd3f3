"""Fill-in-middle over compressed frames against a plain version on whole strings."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from castlens.llm import infill
from tests.llm.helpers import awkward, empty, rows, SCHEMA

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(ident, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    u, v = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not units or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:u]), "".join(units[u:v]), "".join(units[v:])
    if d % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(docs):
    got = infill.digests(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = []
    for r in docs.select("doc_id", "text").collect():
        *head, output = plain(r.doc_id, r.text)
        want.append(repr((r.doc_id, *head, sha(output), sha(r.text or ""))))
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)


def odd_texts(n, seed=4):
    pick = random.Random(seed)
    pool = ["word", "a", " ", "\n", "é", "漢字", "🙂", "<", "S>", "<S", "<P", "M>", "x" * 50, "1", "é" * 30, "<<", ">"]
    return ["".join(pick.choice(pool) for _ in range(pick.randint(0, 60))) for _ in range(n)] + ["a<P>b", "<M>", "<S", "x" * 500, "é" * 400]


@pytest.mark.parametrize("size", [3, 7, 64, infill.FRAME])
def test_digests_with_frames_of_any_size(spark, monkeypatch, size):
    """Cuts inside code points, units, and what looks like a marker, at every frame size."""
    monkeypatch.setattr(infill, "FRAME", size)
    docs = spark.createDataFrame(list(enumerate(odd_texts(300))), "doc_id long, text string")
    store = infill._pack(__import__("pyarrow").array(odd_texts(50)))
    for one, t in zip(store.to_pylist(), odd_texts(50), strict=True):
        assert one["units"][-1] == len(UNIT.findall(t)) and one["chars"][-1] == len(t)
        assert b"".join(infill.unpack(one["frames"])).decode() == t
        for u in range(0, one["units"][-1] + 1, 5):
            k, at, chars = infill._seek(one, u)
            assert sum(one["bytes"][:k]) + at == len("".join(UNIT.findall(t)[:u]).encode()) and chars == len("".join(UNIT.findall(t)[:u]))
    if size == infill.FRAME:
        check(docs)


def test_small_frames_in_a_job(spark, monkeypatch):
    texts = odd_texts(400, 8)
    monkeypatch.setattr(infill, "FRAME", 5)
    cut = [(infill._pack(__import__("pyarrow").array([t])), *plain(i, t)) for i, t in enumerate(texts)]
    for i, (store, _, form, chars, middle, output) in enumerate(cut):
        import pyarrow as pa
        units = UNIT.findall(texts[i])
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        u, v = sorted(int(h[k:k + 8], 16) % (len(units) + 1) for k in (0, 8))
        got = infill._transform(store, pa.array([u]), pa.array([v]), pa.array([form])).to_pylist()[0]
        assert b"".join(infill.unpack(got["frames"])).decode() == output
        assert (got["prefix_chars"], got["middle_chars"]) == (chars, middle)
        assert b"".join(infill.original(got["frames"], form)).decode() == texts[i]


def test_awkward(spark):
    docs = awkward(spark)
    check(docs)
    assert infill.digests(empty(spark)).collect() == []
    done = infill.transform(infill.pack(docs))
    assert set(docs.columns) - {"text"} <= set(done.columns)


def test_real_texts_and_a_plain_zstandard_reader(spark):
    """Outputs are ordinary zstandard streams; texts come back whole, also one of many frames."""
    texts = ["one two three, four", None, "漢字 " * 100_000, " ".join(f"w{i}" for i in range(50_000))]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    done = infill.transform(infill.pack(docs), seed=1)
    got = done.select("doc_id", "form", "fim.frames", infill.text_of(F.col("fim.frames")).alias("output"),
                      infill.restore(F.col("fim.frames"), F.col("form")).alias("back")).collect()
    for r in got:
        assert r.output == plain(r.doc_id, texts[r.doc_id])[4] and r.back == (texts[r.doc_id] or "")
        if r.frames:
            stream = zstandard.ZstdDecompressor().stream_reader(b"".join(bytes(x) for x in r.frames), read_across_frames=True)
            assert stream.read().decode() == r.output
    assert len(got[3].frames) > 3
