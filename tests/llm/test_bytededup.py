"""Suffix-array dedup against a plain version that keeps every window of the corpus in a dictionary."""

from __future__ import annotations

import random

import numpy as np
import pytest

from castlens.llm import bytededup
from castlens.llm.bytededup import WINDOW, dedup_bytes, segments
from castlens.llm.suffixes import factors, nearest_smaller, suffix_ranks
from tests.llm.helpers import awkward, empty


def plain(data, earlier_only, xxhash):
    """(id, n_bytes, n_removed, n_spans, kept) by row; rows of one id and text are one document."""
    docs = {}
    for i, t in data:
        docs.setdefault((i is None, i or 0, xxhash.get(t, 42), t or ""), (t or "").encode())
    places = {}
    for key in sorted(docs):
        raw = docs[key]
        for a in range(len(raw) - WINDOW + 1):
            places.setdefault(raw[a:a + WINDOW], []).append((key, a))
    out = []
    for i, t in data:
        key = (i is None, i or 0, xxhash.get(t, 42), t or "")
        raw = docs[key]
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - WINDOW + 1):
            where = places[raw[a:a + WINDOW]]
            if (where[0] != (key, a)) if earlier_only else len(where) > 1:
                gone[a:a + WINDOW] = True
        gone = gone[:-1]
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(map(repr, out))


def check(docs):
    from pyspark.sql import functions as F
    data = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    xxhash = {r[0]: r[1] for r in docs.select("text", F.xxhash64("text")).distinct().collect()}
    for earlier in (True, False):
        got = dedup_bytes(docs, earlier_only=earlier)
        rows = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
        assert sorted(repr((r[0], r[1], r[2], r[3], bytes(r[4]))) for r in rows) == plain(data, earlier, xxhash), earlier


def corpus(seed, n=60):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeé漢") for _ in range(pick.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(pick.randint(30, 120)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [prose(pick.randint(0, 60))]
        for _ in range(pick.randint(0, 3)):
            p = pick.choice(passages)
            a = pick.randint(0, 40)
            parts += [p[a:] if pick.random() < 0.5 else p, prose(pick.randint(0, 30))]
        texts.append("".join(parts))
    texts += [texts[0], texts[0], texts[3][:250], texts[5][-201:], texts[5][-200:], texts[5][-199:], "x" * 700, "ab" * 300, "x" * 199]
    return list(enumerate(texts))


def test_passages_copies_and_periods(spark):
    for parts in (1, 5):
        check(spark.createDataFrame(corpus(1), "doc_id long, text string").repartition(parts))


def test_repeated_rows_and_missing_ids(spark):
    data = corpus(2, 30)
    data += [data[0], data[0], (None, data[1][1]), (None, data[1][1]), (None, data[2][1]), (7, data[4][1]), (7, data[4][1] + "tail"), (None, None), (3, "")]
    check(spark.createDataFrame(data, "doc_id long, text string").repartition(4))


@pytest.mark.parametrize("small", [{"MOST": 3}, {"OFTEN": 2, "SKETCH": 50}, {"FLUSH": 40, "SHARD": 5}, {"PIECE": 300}, {"MOST": 2, "OFTEN": 1, "FLUSH": 25, "PIECE": 500}])
def test_small_bounds(spark, monkeypatch, small):
    """Anchors dealt by window, salted anchors, many flushes and pieces: the same rows."""
    for k, v in small.items():
        monkeypatch.setattr(bytededup, k, v)
    check(spark.createDataFrame(corpus(3, 40), "doc_id long, text string").repartition(3))


def test_one_edge_in_many_documents(spark, monkeypatch):
    """A passage amid other words everywhere: its edges give different segments of one anchor."""
    monkeypatch.setattr(bytededup, "MOST", 20)
    pick = random.Random(5)
    passage = " ".join(f"p{pick.randrange(10**6)}" for _ in range(60))
    text = lambda: " ".join(f"w{pick.randrange(10**6)}" for _ in range(40))
    check(spark.createDataFrame([(i, f"{text()} {passage} {text()}") for i in range(120)], "doc_id long, text string").repartition(6))


def test_awkward(spark):
    docs = awkward(spark)
    check(docs)
    got = dedup_bytes(docs)
    assert got.columns == [*docs.columns, "kept", "n_bytes", "n_removed", "n_spans"]
    assert dedup_bytes(empty(spark)).collect() == []


def test_equal_windows_share_an_anchor():
    pick = random.Random(8)
    passage = bytes(pick.choice(b"abcd ") for _ in range(600))
    found = {}
    for front in (0, 13, 300):
        raw = bytes(pick.choice(b"efgh") for _ in range(front)) + passage + b"zz" * 50
        data = np.frombuffer(raw, np.uint8)
        start, run, anchor, _ = segments(data, np.array([0, len(data)]))
        assert (start + run <= len(raw) - WINDOW + 1).all() and run.sum() == len(raw) - WINDOW + 1
        for s, r, a in zip(start.tolist(), run.tolist(), anchor.tolist(), strict=True):
            for x in range(s, s + r):
                assert found.setdefault(raw[x:x + WINDOW], a) == a


def test_factors():
    pick = np.random.default_rng(1)
    for _ in range(60):
        n, depth = int(pick.integers(20, 300)), int(pick.integers(1, 12))
        text = pick.integers(97, 97 + int(pick.integers(1, 4)), n).astype(np.uint8)
        starts = np.arange(n - depth + 1)
        rank = suffix_ranks(text, starts, depth)
        words = [text[s:s + depth].tobytes() for s in starts]
        order = {w: k for k, w in enumerate(sorted(set(words)))}
        assert rank.tolist() == [order[w] for w in words]
        place = pick.permutation(len(starts))
        previous, following = factors(rank, place, depth)
        for i, w in enumerate(words):
            others = [place[j] for j, v in enumerate(words) if v == w]
            assert (previous[i] >= depth) == (min(others) < place[i]) and (following[i] >= depth) == (max(others) > place[i])


def test_nearest_smaller():
    pick = np.random.default_rng(2)
    for _ in range(80):
        n = int(pick.integers(1, 60))
        place, common = pick.permutation(n), np.append(0, pick.integers(0, 3, n - 1) * 5)
        least = nearest_smaller(place, common)[1]
        for i in range(n):
            j, low = i, 10**9
            while True:
                low, j = min(low, common[j]), j - 1
                if j < 0 or not low or place[j] < place[i]:
                    break
            assert least[i] == (low if j >= 0 and place[j] < place[i] else 0)
