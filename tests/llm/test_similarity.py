"""N-gram Jaccard join, fingerprints and embedding near-dedup against all pairs in plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from castlens.llm import neardup, ngramjoin
from castlens.llm.components import components
from castlens.llm.fingerprint import chain, near_duplicates
from castlens.llm.ngramjoin import jaccard_links, keep_one, least_matches
from tests.llm.helpers import SCHEMA, awkward, classes, empty, jaccard, rows, shingles


def near_corpus(seed=4):
    """Groups of near copies, exact copies, and documents of their own."""
    pick = random.Random(seed)
    vocab = [f"t{i}" for i in range(5000)]
    texts = []
    for size in (40, 6, 3, 2):
        base = [pick.choice(vocab) for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(pick.randint(0, 4)):
                w[pick.randrange(len(w))] = pick.choice(vocab)
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 3
    texts += [" ".join(pick.choice(vocab) for _ in range(pick.randint(1, 60))) for _ in range(60)]
    pick.shuffle(texts)
    return texts


def plain_links(data):
    """{row: (n_links, class)} by position; the class is the least id of the component, null ids last."""
    sets = [shingles(t) for _, t in data]
    links = [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    count = [0] * len(data)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = classes(len(data), links)
    low = {}
    for x, r in enumerate(root):
        i = data[x][0]
        if sets[x]:
            low[r] = min(low.get(r, (True, 0)), (i is None, i or 0))
    return sorted(repr((data[x][0], count[x], data[x][0] if not sets[x] else None if low[root[x]][0] else low[root[x]][1]))
                  for x in range(len(data)))


def check_links(docs):
    got = jaccard_links(docs).collect()
    assert sorted(repr((r.doc_id, r.n_links, r.class_id)) for r in got) == plain_links([(r.doc_id, r.text) for r in docs.collect()])
    return got


def test_join_awkward(spark):
    docs = awkward(spark)
    check_links(docs)
    assert jaccard_links(empty(spark)).collect() == [] and keep_one(empty(spark)).collect() == []
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    blank = [r for r in kept.collect() if not shingles(r.text)]
    assert len(blank) == 5                                  # texts without words all stay


def test_join_random_in_one_tile_and_in_many(spark, monkeypatch):
    docs = spark.createDataFrame(rows(near_corpus()), SCHEMA).repartition(5)
    got = check_links(docs)
    stay = sorted(r.doc_id for r in got if r.kept)
    assert stay == sorted({r.class_id for r in got})
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == stay
    monkeypatch.setattr(ngramjoin, "TILE", 7)              # a group of 40 in 6 tiles
    check_links(docs)


def test_pruning_tolerance():
    """A pair of similarity 0.8 is dropped with at most the tolerance at each look."""
    from math import comb
    for n, m in least_matches(0.8, 1e-6):
        assert sum(comb(n, x) * 0.8**x * 0.2**(n - x) for x in range(m)) < 4e-6
        assert m > 0 or n < 16


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{200 + i: 200 for i in range(9)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def check_chain(docs):
    data = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True,
                  key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    exp = []
    for k, (i, t) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        exp.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    got = chain(docs).collect()
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(repr(x[:3]) for x in exp)
    marks = {}
    off = []
    by = {(r.doc_id, r.edited_sha256, r.n_chars): r for r in got}
    for i, n, sha, t, edited, after in exp:
        r = by[i, sha, n]
        assert marks.setdefault(t, r.fingerprint) == r.fingerprint        # equal texts, equal fingerprints
        assert marks.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        same = lambda a, b: 1.0 if shingles(a) == shingles(b) else jaccard(shingles(a), shingles(b))
        off += [abs(r.near_edited - same(t, edited)), abs(r.near_next - same(t, after))]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.05


def test_chain_awkward_and_ranges(spark):
    check_chain(awkward(spark))
    check_chain(spark.createDataFrame(rows(near_corpus()), SCHEMA).repartition(4))
    check_chain(spark.createDataFrame(rows(["only one document here"]), SCHEMA))
    assert chain(empty(spark)).collect() == []


def test_fingerprint_bands_and_verification(spark):
    texts = near_corpus()
    md5 = {hashlib.md5(t.encode()).hexdigest(): t for t in texts}
    got = near_duplicates(spark.createDataFrame(rows([*texts, None, ""]), SCHEMA)).collect()
    for r in got:
        j = jaccard(shingles(md5[r.tk]), shingles(md5[r.near]))
        assert j >= 0.8 and abs(j - r.jaccard) < 1e-12
    lonely = {k for k, t in md5.items() if all(jaccard(shingles(t), shingles(u)) < 0.8 for u in md5.values() if u != t)}
    assert {r.tk for r in got} | {r.near for r in got} == set(md5) - lonely


def vectors(seed=6, n=400, dim=64):
    """Clusters of close vectors, copies, multiples of one vector, and every kind of row that links with nothing."""
    r = np.random.default_rng(seed)
    data = []
    for c in range(30):
        base = r.standard_normal(dim)
        for _ in range(r.integers(1, 12)):
            data.append((base + r.standard_normal(dim) * r.choice([0.1, 0.25, 0.33]), c % 3))
    data += [(r.standard_normal(dim), int(r.integers(0, 3))) for _ in range(n - len(data))]
    data += [data[0], data[0], (data[0][0] * 3, data[0][1]), (data[0][0], 99), (data[0][0], None)]
    out = [(i, v.astype(np.float32).tolist(), lab, "x") for i, (v, lab) in enumerate(data)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [1.0, None], [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0]]
    out += [(1000 + i, v, 0, "x") for i, v in enumerate(bad)]
    return out + [(None, out[0][1], out[0][2], "x")]


VECTORS = "vec_id long, embedding array<float>, label int, tk string"


def plain_cosines(data):
    ok = [(k, np.array(v, dtype=float)) for k, (_, v, lab, _) in enumerate(data)
          if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for x, (a, u) in enumerate(ok) for b, v in ok[:x] if data[a][2] == data[b][2] and len(u) == len(v)
             and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93]
    count = [0] * len(data)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = classes(len(data), links)
    low = {}
    for x, r in enumerate(root):
        if data[x][0] is not None:
            low[r] = min(low.get(r, data[x][0]), data[x][0])
    return [(data[x][0], count[x], low.get(root[x])) for x in range(len(data))]


def test_embeddings_recall_and_components(spark, monkeypatch):
    data = vectors()
    docs = spark.createDataFrame(data, VECTORS).repartition(4)
    exp = plain_cosines(data)
    for tile in (512, 20):
        monkeypatch.setattr(neardup, "TILE", tile)
        got = neardup.near_duplicates(docs).collect()
        assert len(got) == len(data) and sum(r.kept for r in got) == len({r.component_id for r in got} - {None}) + 0
        found, there = sum(r.n_links for r in got), sum(x[1] for x in exp)
        assert there > 500 and 0.99 * there <= found <= there
        if found == there:
            assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got) == sorted(map(repr, exp))


def test_embeddings_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    one = neardup.near_duplicates(spark.createDataFrame([(1, None, None, "x")], VECTORS)).collect()
    assert [tuple(r) for r in one] == [(1, 0, 1, True)]
