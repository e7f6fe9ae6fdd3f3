"""Graph operators: golden chain fixture, sentinel/capped semantics, brute-force
checks of the pair statistics and of BFS on a driver table."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict, deque

from pyspark.sql import functions as F

from castlens.operators import graph as G
from castlens.plans.queries import _credits
from castlens.plans.tables import GRAPH_ROLES
from castlens.sources.readers import read_principals
from tests.conftest import SF_SMOKE
from tests.fixtures import SOURCE, expected_chain_distances, write_chain


def _chain_credits(spark, tmp_dir, roles=("actor", "actress")):
    return G.credits(read_principals(spark, write_chain(tmp_dir)), roles=roles)


def test_chain_full_bfs_matches_golden(spark, tmp_dir):
    c = _chain_credits(spark, tmp_dir)
    got = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(c), SOURCE).collect()}
    assert got == expected_chain_distances()
    assert len(got) == 16


def test_chain_capped_depth3_sentinel(spark, tmp_dir):
    c = _chain_credits(spark, tmp_dir)
    got = {r.person: r.distance for r in G.bfs_distances_capped(c, SOURCE, max_depth=3).collect()}
    exp = {p: (d if d <= 3 else G.UNREACHED) for p, d in expected_chain_distances().items()}
    assert got == exp
    for i in range(10, 16):
        assert got[f"nm{i:07d}"] == 10000


def test_unknown_source(spark, tmp_dir):
    c = _chain_credits(spark, tmp_dir)
    full = G.bfs_distances(G.bipartite_edges(c), "nm9999999").collect()
    assert [(r.person, r.distance) for r in full] == [("nm9999999", 0)]
    capped = G.bfs_distances_capped(c, "nm9999999", max_depth=6).collect()
    assert len(capped) == 16 and all(r.distance == 10000 for r in capped)


def test_chain_pair_counts(spark, tmp_dir):
    c = _chain_credits(spark, tmp_dir)
    stats = G.title_pair_stats(c).collect()
    assert sum(r.combo_pairs for r in stats) == 30
    assert all(r.directed_pairs == 12 for r in stats)


def _brute_title_stats(rows):
    by_title = defaultdict(list)
    for t, p in rows:
        by_title[t].append(p)
    out = {}
    for t, ps in by_title.items():
        combos = {tuple(sorted(c)) for c in itertools.combinations(ps, 2)}
        directed = sum(1 for i in range(len(ps)) for j in range(len(ps)) if i != j)
        out[t] = (len(ps), len(set(ps)), len(combos), directed)
    return out


def test_title_pair_stats_brute_force(spark):
    c = _credits(spark, SF_SMOKE, ("AF", "RF"))
    rows = [(r.title, r.person) for r in c.collect()]
    got = {r.title: (r.n_credits, r.n_persons, r.combo_pairs, r.directed_pairs)
           for r in G.title_pair_stats(c).collect()}
    assert got == _brute_title_stats(rows)


def test_title_pair_stats_self_pairs(spark):
    df = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), ("u", "c")], "title string, person string")
    got = {r.title: (r.combo_pairs, r.directed_pairs) for r in G.title_pair_stats(df).collect()}
    assert got == {"t": (2, 6), "u": (0, 0)}   # {a,a},{a,b}; 3·2 ordered positions


def test_neighbour_slots_brute_force(spark):
    c = _credits(spark, SF_SMOKE)
    rows = [(r.title, r.person) for r in c.collect()]
    by_title = defaultdict(list)
    for t, p in rows:
        by_title[t].append(p)
    adj = defaultdict(list)
    for ps in by_title.values():
        for i in range(len(ps)):
            for j in range(i + 1, len(ps)):
                adj[ps[i]].append(ps[j])
                adj[ps[j]].append(ps[i])
    got = {r.person: (r.distance, r.n_neighbours) for r in G.neighbour_slots(c, 0).collect()}
    exp = {p: (0 if p == 0 else 10000, len(v)) for p, v in adj.items()}
    assert got == exp


def test_cast_lists_chunking(spark):
    c = _credits(spark, SF_SMOKE)
    rows = [(r.title, r.person) for r in c.collect()]
    exp = defaultdict(list)
    for t, p in rows:
        exp[t].append(p)
    # chunk_size 2 forces the split path for every title with 3+ distinct persons
    got = defaultdict(list)
    for r in G.cast_lists(c, chunk_size=2).collect():
        assert r.persons == sorted(r.persons) and len(r.persons) == len(r.counts)
        n_distinct = len(set(exp[r.title]))
        assert 0 <= r.chunk < max(1, -(-n_distinct // 2))
        for person, k in zip(r.persons, r.counts):
            got[r.title].extend([person] * k)
    assert {t: sorted(v) for t, v in got.items()} == {t: sorted(v) for t, v in exp.items()}
    # the plain form: one row per title, its distinct persons sorted, with multiplicities
    one = {r.title: list(zip(r.persons, r.counts)) for r in G.cast_lists(c, chunk_size=1000).collect()}
    assert one == {t: sorted(Counter(v).items()) for t, v in exp.items()}


def test_cast_lists_collapse_copies(spark):
    """A credit copied many times is one entry with its count, not a list slot per copy."""
    rows = [("t", "a")] * 500 + [("t", "b"), ("u", "a")]
    df = spark.createDataFrame(rows, "title string, person string")
    got = {r.title: (r.persons, r.counts) for r in G.cast_lists(df, chunk_size=1).collect()
           if r.title == "u" or len(r.persons)}
    assert got["u"] == (["a"], [1])
    t_rows = [(r.persons, r.counts) for r in G.cast_lists(df, chunk_size=1).collect() if r.title == "t"]
    assert sorted(p for ps, _ in t_rows for p in ps) == ["a", "b"]
    assert sum(k for _, ks in t_rows for k in ks) == 501


def _python_bfs(pairs, source):
    by_title = defaultdict(set)
    by_person = defaultdict(set)
    for t, p in pairs:
        by_title[t].add(p)
        by_person[p].add(t)
    dist = {source: 0}
    q = deque([source])
    while q:
        u = q.popleft()
        for t in by_person.get(u, ()):
            for v in by_title[t]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    q.append(v)
    return dist


def test_bfs_matches_python_bfs_on_driver_table(spark):
    c = _credits(spark, SF_SMOKE, GRAPH_ROLES)
    pairs = [(r.title, r.person) for r in c.collect()]
    exp = _python_bfs(pairs, 0)
    got = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(c), 0).collect()}
    assert got == exp
    # property: every non-source node at d has a neighbour at d-1 and none below
    by_title = defaultdict(set)
    by_person = defaultdict(set)
    for t, p in pairs:
        by_title[t].add(p)
        by_person[p].add(t)
    for p, d in got.items():
        if d == 0:
            continue
        nd = [got[q] for t in by_person[p] for q in by_title[t] if q != p and q in got]
        assert min(nd) == d - 1


def test_capped_equals_full_restricted(spark):
    c = _credits(spark, SF_SMOKE, GRAPH_ROLES)
    full = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(c), 0).collect()}
    nodes = {r.person for r in G.graph_nodes(c).collect()}
    capped = {r.person: r.distance for r in G.bfs_distances_capped(c, 0, max_depth=4).collect()}
    exp = {p: (full[p] if p in full and full[p] <= 4 else 10000) for p in nodes}
    assert capped == exp


def test_histogram_and_gathered(spark, tmp_dir):
    c = _chain_credits(spark, tmp_dir)
    d = G.bfs_distances(G.bipartite_edges(c), SOURCE)
    hist = {r.distance: r.n_nodes for r in G.level_histogram(d).collect()}
    assert hist == {0: 1, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3}
    g = G.gather_distances(d).collect()
    assert all(len(r.distances) == 1 for r in g)


def test_bfs_plan_has_no_cartesian_or_python(spark):
    c = _credits(spark, SF_SMOKE, GRAPH_ROLES)
    df = G.bfs_distances(G.bipartite_edges(c), 0, max_depth=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "ArrowEvalPython" not in plan


def test_null_keys_link_nobody(spark):
    df = spark.createDataFrame([("t1", "a"), ("t1", None), ("t1", "b"), (None, "a"), (None, "c")],
                               "tconst string, nconst string").withColumn("category", F.lit("actor"))
    c = G.credits(df)
    assert c.count() == 2
    got = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(c), "a").collect()}
    assert got == {"a": 0, "b": 1}


def test_bipartite_form_equals_pair_form(spark):
    """Distances on the bipartite graph equal distances on the co-appearance pair graph
    (pairs built here by brute force, 2-combinations of every cast list)."""
    c = _credits(spark, SF_SMOKE, GRAPH_ROLES)
    by_title = defaultdict(list)
    for r in c.collect():
        by_title[r.title].append(r.person)
    adj = defaultdict(set)
    for cast in by_title.values():
        for a, b in itertools.combinations(cast, 2):
            adj[a].add(b)
            adj[b].add(a)
    dist, q = {0: 0}, deque([0])
    while q:
        u = q.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                q.append(v)
    got = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(c), 0).collect()}
    assert got == dist


def test_cast_lists_one_path(spark):
    """The plan does not depend on how large the titles are: no job runs while it is built."""
    c = _credits(spark, SF_SMOKE)
    plans = [G.cast_lists(c, chunk_size=k)._jdf.queryExecution().optimizedPlan().toString() for k in (2, 100_000)]
    # the join with the number of chunks, and on either side the one with the hot titles (none here)
    assert plans[0].count("Join") == plans[1].count("Join") == 3


def test_deep_search_has_a_small_plan(spark):
    """A path of 40 hops: the result reads the written levels, whatever their number."""
    rows = [(t, p) for t in range(40) for p in (t, t + 1)]
    e = spark.createDataFrame(rows, "title long, person long")
    out = G.bfs_distances(e, 0, hops=3)
    assert {r.person: r.distance for r in out.collect()} == {p: p for p in range(41)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_pair_counts_are_exact_wide_integers(spark):
    """Pair counts are decimal(38,0): a title with 10^11 credits has ~10^22 pairs."""
    df = spark.createDataFrame([("t", "a"), ("t", "b")], "title string, person string")
    types = dict(G.title_pair_stats(df).dtypes)
    assert types["combo_pairs"] == "decimal(38,0)" and types["directed_pairs"] == "decimal(38,0)"
    assert dict(G.neighbour_slots(df, "a").dtypes)["n_neighbours"] == "decimal(38,0)"
    n = 10**11
    big = spark.range(1).select(F.lit(n).alias("n")).select(
        (F.col("n").cast("decimal(38,0)") * (F.col("n").cast("decimal(38,0)") - 1)).cast("decimal(38,0)").alias("p"))
    assert int(big.first().p) == n * (n - 1)


def test_source_given_as_text_for_numeric_keys(spark):
    c = _credits(spark, SF_SMOKE, GRAPH_ROLES)
    a = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(c), 0).collect()}
    b = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(c), "0").collect()}
    assert a == b and len(a) > 1
