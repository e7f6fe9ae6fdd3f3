"""Periodic runs against plain versions that try every period at every word."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from castlens.llm import periodic
from castlens.llm.periodic import Extensions, collapse_runs, find_runs, plant_runs
from tests.llm.helpers import LONG, awkward, empty, words


def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and i > s:
                best.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(ident, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(ident).encode())
    g = h // 10
    if ident is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + i % p] for i in range(n - a)]
    runs = plain_runs(w) if n < 5000 else []
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (ident, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences(pick, n):
    out = []
    for _ in range(n):
        t = []
        for _ in range(pick.randint(0, 8)):
            period = [pick.randint(0, pick.choice([1, 2, 5])) for _ in range(pick.randint(1, 9))]
            t += (period * pick.randint(1, 9))[:pick.randint(1, 60)]
        out.append(t)
    return out


@pytest.mark.parametrize("asked", [5, periodic.ASKED])
def test_runs_of_random_sequences(monkeypatch, asked):
    monkeypatch.setattr(periodic, "ASKED", asked)
    pick = random.Random(1)
    for _ in range(120):
        texts = sequences(pick, pick.randint(1, 6))
        first = np.cumsum([0] + [len(t) for t in texts])
        got = list(zip(*(x.tolist() for x in find_runs(np.array(sum(texts, []), dtype=np.int64), first)), strict=True))
        assert got == [(s + int(f), n, q) for t, f in zip(texts, first, strict=False) for s, n, q in plain_runs(t)]


def test_extensions():
    pick = np.random.default_rng(3)
    for top in (1, 2, 50):
        text = np.append(pick.integers(1, top + 1, 400), top + 1)
        text[200:300] = text[100:200]
        i, j = pick.integers(0, 401, 900), pick.integers(0, 401, 900)
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(402) if max(a, b) + k >= 401 or text[a + k] != text[b + k]) for a, b in zip(i, j, strict=True)]
        assert Extensions(text).common(i, j).tolist() == want


def test_query_rows(spark):
    pick = random.Random(6)
    data = [(i, " ".join(f"w{x}" for x in t)) for i, t in enumerate(sequences(pick, 400))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = periodic.digests(plant_runs(docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((plain_row(*r) for r in data), key=lambda r: r[0])


def test_awkward(spark):
    docs = awkward(spark)
    got = [tuple(r) for r in periodic.digests(plant_runs(docs)).collect()]
    want = [plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    short = [r.doc_id for r in docs.collect() if r.text != LONG]
    assert sorted(map(repr, (r for r in got if r[0] in short))) == sorted(map(repr, (r for r in want if r[0] in short)))
    assert len(got) == len(want)
    assert periodic.digests(plant_runs(empty(spark))).collect() == []
    out = collapse_runs(docs)
    assert out.columns == [*docs.columns, "periodic"] and out.drop("periodic").exceptAll(docs).count() == 0


def test_long_text(spark):
    """A run of 50,000 words with period 977 within 120,000 words, and one word 30,000 times."""
    w = [f"a{i}" for i in range(20_000)] + [f"p{i % 977}" for i in range(50_000)] + [f"b{i}" for i in range(20_000)] + ["same"] * 30_000
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w))], "doc_id long, text string")
    for r in collapse_runs(docs).select("periodic.runs", F.size(F.split("periodic.collapsed", " ")).alias("n")).collect():
        assert [tuple(x) for x in r.runs] == [(20_000, 50_000, 977), (90_000, 30_000, 1)] and r.n == 20_000 + 977 + 20_000 + 1
