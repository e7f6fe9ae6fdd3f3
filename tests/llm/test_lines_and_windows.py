"""Line dedup and substring dedup against plain Python versions."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from castlens.llm import substring
from castlens.llm.fmindex import FMIndex
from castlens.llm.linededup import dedup_lines, filter_bits
from castlens.llm.substring import WINDOW, dedup_substrings
from tests.llm.helpers import LINE, awkward, empty, rows, words, SCHEMA

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_lines(data):
    """{position: (text, n_lines, n_dropped)} of (id, text) rows."""
    holds = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, t in data:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holds[key(line)].add(i)
    top = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in holds.items() if len(v) >= 3}
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


def test_lines_awkward(spark):
    docs = awkward(spark)
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_dropped"]
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == \
        plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert dedup_lines(empty(spark)).collect() == []


def test_lines_random(spark):
    pick = random.Random(5)
    pool = [f"  Line number {i} of the shared pool \x0b" for i in range(30)] + ["short", "", "é" * 20, "É" * 20]
    data = [(i, "\n".join(pick.choice(pool) if pick.random() < 0.7 else f"own line of document {i} {pick.random()}"
                          for _ in range(pick.randint(0, 12)))) for i in range(300)]
    got = dedup_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(7))
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == plain_lines(data)


def test_filters_grow_with_the_documents_within_bounds():
    assert filter_bits(0) == 1 << 20 and filter_bits(10**6) == 1 << 27 and filter_bits(10**12) == 1 << 30


def plain_windows(data):
    """(id, n_words, kept words) by row, windows in order of id (null ids last) and start."""
    order = sorted(range(len(data)), key=lambda x: (data[x][0] is None, data[x][0] or 0))
    place = {}
    for x in order:
        i, t = data[x]
        w = words(t)
        for a in range(len(w) - WINDOW + 1):
            k = tuple(w[a:a + WINDOW])
            here = ((i is None, i or 0), a)
            place[k] = min(place.get(k, here), here)
    out = []
    for i, t in data:
        w = words(t)
        bad = set()
        for a in range(len(w) - WINDOW + 1):
            if place[tuple(w[a:a + WINDOW])] < ((i is None, i or 0), a):
                bad.update(range(a, a + WINDOW))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in bad), len(w), len(bad)))
    return sorted(map(repr, out))


def check_windows(docs):
    got = dedup_substrings(docs)
    assert sorted(repr((r.doc_id, r.text, r.n_words, r.n_removed)) for r in got.collect()) == \
        plain_windows([(r.doc_id, r.text) for r in docs.collect()])


def test_windows_awkward(spark):
    docs = awkward(spark)
    assert set(docs.columns) <= set(dedup_substrings(docs).columns)
    check_windows(docs)
    assert dedup_substrings(empty(spark)).collect() == []


def corpus(seed, n=80):
    pick = random.Random(seed)
    vocab = [f"v{i}" for i in range(40)]
    passages = [[pick.choice(vocab) for _ in range(size)] for size in (19, 20, 21, 25, 60)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(pick.randint(0, 4)):
            w += [pick.choice(vocab) for _ in range(pick.randint(0, 25))] + pick.choice(passages)
        if pick.random() < 0.2:
            w += ["a", "b"] * 20 + ["a"] * 30
        out.append(" ".join(w))
    return out


def test_windows_random(spark):
    check_windows(spark.createDataFrame(rows(corpus(1)), SCHEMA).repartition(5))


def test_windows_of_a_hot_anchor_are_split(spark, monkeypatch):
    """One passage in very many contexts: its anchors' segments are dealt to shards by window hash."""
    pick = random.Random(2)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([f"x{pick.randint(0, 3)}" for _ in range(12)] + passage + [f"y{pick.randint(0, 3)}" for _ in range(12)]) for _ in range(150)]
    monkeypatch.setattr(substring, "SHARD_SEGMENTS", 8)
    docs = spark.createDataFrame(rows(texts), SCHEMA).coalesce(2)
    seen = []
    emit = substring._emit
    monkeypatch.setattr(substring, "_emit", lambda hot: seen.append(hot) or emit(hot))
    check_windows(docs)
    assert seen[0] and max(seen[0].values()) > 1


def test_fm_index_counts_and_places():
    pick = np.random.default_rng(3)
    text = pick.integers(0, 6, 500)
    text[-1] = 0
    index = FMIndex(text)
    end = np.arange(10, 500)
    matched, lo, hi = index.matching(text, end, 8)
    for e, m, a, b in zip(end, matched, lo, hi, strict=True):
        if (text[e - 8:e + 1] == 0).any():
            continue                                       # patterns hold no separator
        places = [i for i in range(500) if i + m <= 500 and (text[i:i + m] == text[e - m + 1:e + 1]).all()]
        if m:
            assert sorted(index.order[a:b]) == places and len(places) >= 2
        if m < 8:
            longer = [i for i in range(500 - m) if (text[i:i + m + 1] == text[e - m:e + 1]).all()]
            assert len(longer) < 2


def test_line_constant_is_long_enough():
    assert len(LINE) >= 20
