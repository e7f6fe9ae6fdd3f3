"""Property test: BFS on random bipartite graphs equals a Python BFS, and the
capped form equals the full form cut at the depth limit."""

from __future__ import annotations

from collections import defaultdict, deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from castlens.operators import graph as G

credits_strategy = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 20)), min_size=1, max_size=60)


def python_bfs(pairs, source):
    by_title, by_person = defaultdict(set), defaultdict(set)
    for t, p in pairs:
        by_title[t].add(p)
        by_person[p].add(t)
    dist, q = {source: 0}, deque([source])
    while q:
        u = q.popleft()
        for t in by_person.get(u, ()):
            for v in by_title[t]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    q.append(v)
    return dist


@settings(max_examples=6, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=credits_strategy, source=st.integers(0, 20), depth=st.integers(1, 3))
def test_random_graphs(spark, pairs, source, depth):
    df = spark.createDataFrame(pairs, "title long, person long")
    full = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(df), source).collect()}
    assert full == python_bfs(pairs, source)
    sizes = defaultdict(int)
    for t, _ in pairs:
        sizes[t] += 1
    nodes = {p for t, p in pairs if sizes[t] >= 2}
    capped = {r.person: r.distance for r in G.bfs_distances_capped(df, source, max_depth=depth).collect()}
    assert capped == {p: (full[p] if p in full and full[p] <= depth else 10000) for p in nodes}
