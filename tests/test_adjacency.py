"""Compressed adjacency rows against plain sets: bounded chunks, all key ranges, hot owners, neighbours of everyone."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from castlens.operators.adjacency import compressed_rows, decoded, members_between, neighbours


def edges(spark, rows):
    return spark.createDataFrame(rows, "title long, person long")


def cases():
    rng = random.Random(4)
    dense = [(1, k) for k in range(1000, 1100)]                                   # one third of all rows on one title
    clustered = [(2, k) for k in range(40)] + [(2, 10**15 + 7 * k) for k in range(30)] + [(2, 1 << 61)]
    sparse = [(3, rng.randrange(1 << 62)) for _ in range(90)]
    few = [(t, rng.randrange(300)) for t in range(10, 40) for _ in range(rng.randrange(1, 6))]
    odd = [(5, 0), (5, 0), (6, 255), (6, 256), (6, 511), (None, 3), (7, None), (None, None)]
    return dense + clustered + sparse + few + odd + dense[:20]


@pytest.mark.parametrize("chunk_keys, hot_rows", [(1, 10), (4, 20), (8, 1_000_000), (4096, 1_000_000)])
def test_chunks_are_bounded_and_whole(spark, chunk_keys, hot_rows):
    rows = cases()
    want = defaultdict(set)
    for t, p in rows:
        if t is not None and p is not None:
            want[t].add(p)
    chunks = compressed_rows(edges(spark, rows), "title", "person", chunk_keys=chunk_keys, hot_rows=hot_rows).cache()
    got = defaultdict(list)
    for r in decoded(chunks, "person", ["title"]).collect():
        got[r.title].append(r.person)
    assert {t: sorted(p) for t, p in got.items()} == {t: sorted(p) for t, p in want.items()}
    per = defaultdict(list)
    for c in chunks.collect():
        assert 1 <= c.n <= chunk_keys and len(c.packed) == c.n * c.width and c.first <= c.last
        per[c.title].append((c.chunk, c.first, c.last))
    for t, cs in per.items():
        cs.sort()
        assert all(a[2] < b[1] for a, b in zip(cs, cs[1:], strict=False))          # ranges in key order, none overlaps
        if len(want[t]) <= chunk_keys:
            assert len(cs) == 1
    assert len(per[1]) <= 2 * 100 / chunk_keys + 100 / chunk_keys + 2               # dense keys: few chunks
    chunks.unpersist()


def test_a_range_reads_its_chunks_only(spark):
    chunks = compressed_rows(edges(spark, cases()), "title", "person", chunk_keys=8)
    got = members_between(chunks, "title", "person", 1010, 1013)
    assert sorted((r.title, r.person) for r in got.collect()) == [(1, k) for k in range(1010, 1014)]


def test_no_edges(spark):
    none = compressed_rows(edges(spark, []), "title", "person")
    assert none.collect() == [] and decoded(none, "person", ["title"]).collect() == []


def test_neighbours_of_every_person(spark):
    rng = random.Random(9)
    rows = [(0, p) for p in range(60)] + [(t, rng.randrange(90)) for t in range(1, 50) for _ in range(4)] + [(99, 500)]
    casts = defaultdict(set)
    for t, p in rows:
        casts[t].add(p)
    want = defaultdict(int)
    for members in casts.values():
        for a in members:
            for b in members - {a}:
                want[a, b] += 1
    e = edges(spark, rows + rows[:30])
    both = (compressed_rows(e, "person", "title", chunk_keys=3), compressed_rows(e, "title", "person", chunk_keys=7))
    got = neighbours(*both, e.select("person"), hot_rows=10)
    assert {(r.person, r.neighbour): r.n_titles for r in got.collect()} == dict(want)
    some = spark.createDataFrame([(3,), (3,), (None,), (500,), (12345,)], "person long")
    assert {(r.person, r.neighbour) for r in neighbours(*both, some).collect()} == {k for k in want if k[0] == 3}
