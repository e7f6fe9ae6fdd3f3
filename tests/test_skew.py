"""A title holding a third of all credits: the shuffled join is split by AQE,
partial aggregation bounds the hot person, and BFS stays exact when nothing may
be broadcast."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from castlens.operators import graph as G
from castlens.operators.ratings import average_metric_per_person
from castlens.operators.skew import hot_keys, skew_join

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _skewed(spark, n=30000):
    # every third credit belongs to title 0
    cr = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("tconst"),
        (F.col("id") % 5000).alias("nconst"), F.lit("actor").alias("category"))
    rt = spark.range(n).select(F.col("id").alias("tconst"),
                               (F.col("id") % 10).cast("double").alias("averageRating"))
    return cr, rt


def test_hot_title_join_is_split(spark):
    cr, rt = _skewed(spark)
    with conf(spark, SKEW_CONF):
        df = average_metric_per_person(cr, rt, roles=None, sort=False)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan
    assert len(rows) == 5000


def _python_bfs(pairs, source):
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


def test_bfs_exact_without_broadcasts_and_hot_title(spark):
    cr, _ = _skewed(spark, 3000)
    # a chain hanging off the hot title so the search has several levels
    chain = spark.range(1, 12).select((F.col("id") + 100000).alias("tconst"),
                                      (F.col("id") + 7000).alias("nconst"), F.lit("actor").alias("category"))
    link = spark.range(1, 12).select((F.col("id") + 100000).alias("tconst"),
                                     (F.col("id") + 6999).alias("nconst"), F.lit("actor").alias("category"))
    start = spark.createDataFrame([(100001, 0)], "tconst long, nconst long").withColumn("category", F.lit("actor"))
    all_cr = cr.unionByName(chain).unionByName(link).unionByName(start)
    e = G.credits(all_cr)
    pairs = [(r.title, r.person) for r in e.collect()]
    with conf(spark, SKEW_CONF):
        got = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(e), 0).collect()}
    assert got == _python_bfs(pairs, 0)
    assert max(got.values()) > 5


def _chained(spark, n=3000):
    """The hot title, and a chain of ten titles hanging off it."""
    cr, _ = _skewed(spark, n)
    chain = spark.range(1, 10).select((F.col("id") + 100000).alias("tconst"),
                                      (F.col("id") + 7000).alias("nconst"), F.lit("actor").alias("category"))
    link = spark.range(1, 10).select((F.col("id") + 100000).alias("tconst"),
                                     (F.col("id") + 6999).alias("nconst"), F.lit("actor").alias("category"))
    start = spark.createDataFrame([(100001, 0)], "tconst long, nconst long").withColumn("category", F.lit("actor"))
    return G.credits(cr.unionByName(chain).unionByName(link).unionByName(start))


@pytest.mark.parametrize("bounds", [{}, {"hot_rows": 50}, {"hot_rows": 50, "small_rows": 20, "hops": 3}, {"small_rows": 5, "hops": 1}, {"hops": 9}])
def test_search_reads_the_bucketed_tables_as_they_lie(spark, monkeypatch, bounds):
    """No shuffle and no sort of the edges at any hop, nothing cached, no nested loops; exact at all bounds."""
    e = _chained(spark)
    pairs = [(r.title, r.person) for r in e.collect()]
    plans = []
    reach = G._reach

    def spy(*args):
        out = reach(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(G, "_reach", spy)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    got = {r.person: r.distance for r in G.bfs_distances(G.bipartite_edges(e), 0, **bounds).collect()}
    assert got == _python_bfs(pairs, 0)
    assert before == {k: spark.conf.get(k) for k in before}
    assert plans and not spark.sql("SHOW TABLES").where("tableName LIKE 'castlens_%'").collect()
    for plan in plans:
        assert "Bucketed: true" in plan and "InMemoryTableScan" not in plan and "NestedLoopJoin" not in plan
        assert _above(plan, "FileScan parquet spark_catalog", "Exchange ") == 0, plan
        assert _above(plan, "FileScan parquet spark_catalog", "Sort [") == 0, plan
        # what a hop found is made distinct per task before it moves
        assert re.search(r"Exchange hashpartitioning\(title[^\n]*\n[^\n]*HashAggregate", plan)
    if "hot_rows" in bounds:
        assert any(re.search(r"SortMergeJoin \[title#\d+L, salt#\d+\]", p) for p in plans)


def test_several_hops_share_their_exchanges(spark):
    """A job of h hops shuffles each hop's titles and persons once, however often they are read."""
    e = G.bipartite_edges(_chained(spark))
    staged, got = G.staged(e, n=F.count(F.lit(1)))
    index = G._Index(staged, got["n"], 1_000_000)
    path = G.scratch_path(spark, "level")
    spark.range(1).select(F.col("id").alias("person"), F.lit(0).alias("distance")).write.parquet(path)
    for h in (1, 3, 6):
        plan = G._reach(index, [(path, 0, 0)], 0, h)._jdf.queryExecution().executedPlan().toString()
        made = len(re.findall(r"(?<!, )Exchange hashpartitioning", plan))
        assert made <= 2 * h + 2 and len(re.findall("FileScan parquet spark_catalog", plan)) == 2 * h
    index.drop()


def test_turned_search_drops_reached_persons(spark, monkeypatch):
    """With most persons reached, the tables are rebuilt from the rest; distances stay."""
    pairs = [(0, p) for p in range(300)] + [(k, 298 + k + x) for k in range(1, 12) for x in (0, 1)]
    e = spark.createDataFrame(pairs, "title long, person long")
    sizes = []
    turned = G._turned

    def spy(*args):
        out = turned(*args)
        sizes.append((args[1].n_edges, out.n_edges))
        return out
    monkeypatch.setattr(G, "_turned", spy)
    got = {r.person: r.distance for r in G.bfs_distances(e, 0, small_rows=1, hops=1).collect()}
    assert got == _python_bfs(pairs, 0)
    assert sizes and 2 * sizes[0][1] < sizes[0][0] and all(after < before for before, after in sizes)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def _above(plan: str, scan: str, node_name: str) -> int:
    """Number of nodes fed straight from such a scan (only filters and projections in between)."""
    lines = plan.splitlines()
    bad = 0
    for i, line in enumerate(lines):
        if node_name not in line or "BroadcastExchange" in line:
            continue
        ind = _indent(line)
        for below in lines[i + 1:]:
            if _indent(below) <= ind:
                break
            node = re.sub(r"^\*\(\d+\) ", "", below.lstrip(" :+-"))
            if node.startswith(("Filter", "Project", "ColumnarToRow", "InputAdapter")):
                continue
            bad += node.startswith(scan)
            break
    return bad


# ------------------------------------------------------------------ joins with an aggregated side

def _most_rows_in_a_task(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def _hot_credits(spark, n=30000):
    """Every third credit on title 0, by different persons; the other titles have two."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.floor(F.col("id") / 3)).alias("title"), F.col("id").alias("person"))


def test_hot_keys_are_found_and_bounded(spark):
    cr = _hot_credits(spark).unionByName(spark.createDataFrame([(None, 1)] * 40, "title long, person long"))
    hot = hot_keys(cr, "title", hot_rows=1000).collect()
    key = spark.range(1).select(F.xxhash64(F.lit(0).cast("long"))).first()[0]
    assert [(r.hot_key, r.salts) for r in hot] == [(key, 11)]              # 10,000 and one more: title 0 of ids 1 and 2
    assert hot_keys(cr.where("title > 5"), "title", hot_rows=1000).count() == 0
    assert hot_keys(cr.limit(0), "title", hot_rows=1).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_the_plain_join(spark, how):
    rows = _hot_credits(spark, 3000).unionByName(spark.createDataFrame([(None, 1), (0, None), (0, 5), (0, 5)], "title long, person long"))
    other = rows.where("title % 7 < 4").groupBy("title").agg(F.count("*").alias("salt"))
    got = skew_join(rows, other, "title", how, spread_by=["person"], hot_rows=100)
    want = rows.join(other, "title", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    with pytest.raises(ValueError):
        skew_join(rows, other, "title", "full", spread_by=["person"])


def test_skew_join_spreads_the_hot_key(spark):
    """A third of the rows has one key; joined with an aggregate, no task has much more than its share."""
    rows = _hot_credits(spark)
    sizes = G.title_sizes(rows)
    with conf(spark, SKEW_CONF):
        plain = _most_rows_in_a_task(rows.join(sizes, "title"))
        spread = _most_rows_in_a_task(skew_join(rows, sizes, "title", spread_by=["person"], hot_rows=500))
    assert plain > 10_000 and spread < 6_000


@pytest.mark.parametrize("operator", ["slots", "lists", "nodes", "ratings"])
def test_operators_split_a_hot_title(spark, operator):
    """The join of each operator with a per-title aggregate is on (title, salt), and its rows are those of the unsplit one."""
    rows = _hot_credits(spark, 6000)
    runs = {"slots": lambda hot: G.neighbour_slots(rows, 0, hot_rows=hot), "lists": lambda hot: G.cast_lists(rows, 100, hot_rows=hot),
            "nodes": lambda hot: G.graph_nodes(rows, hot_rows=hot),
            "ratings": lambda hot: average_metric_per_person(
                rows.withColumnRenamed("title", "tconst").withColumnRenamed("person", "nconst"),
                spark.range(6000).select((F.col("id") % 2000).alias("tconst"), F.col("id").cast("double").alias("averageRating"), F.col("id").alias("at")),
                roles=None, dedupe_order_by="at", sort=False, hot_rows=hot)}
    with conf(spark, SKEW_CONF):
        got, want = runs[operator](200), runs[operator](10**9)
        got_rows = sorted(map(repr, got.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got_rows == sorted(map(repr, want.collect()))
    assert re.search(r"SortMergeJoin(\(skew=true\))? \[(title|_t)#\d+L?, salt#\d+\]", plan)
