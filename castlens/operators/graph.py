"""Co-appearance graph operators: cast lists, pair statistics, BFS distances.

The graph is kept in its bipartite form — one row per (title, person) credit —
and never expanded into person pairs. Two persons are neighbours when they
share a title, so person → title → person is one hop; distances are the same
as on the pair graph, but a step scans edges instead of listing pairs, which
grow with the square of a cast, and a title is expanded once.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from castlens.constants import UNREACHED  # re-exported
from castlens.functions.columns import stable_bucket
from castlens.operators.joins import bucket_session, bucketed, staged
from castlens.operators.ratings import role_filter
from castlens.operators.skew import HOT_ROWS, hot_keys, per_salt, skew_join, with_salt
from castlens.session import checkpoint_dir, scratch_path

# exact integer type for counts that can exceed 64 bits (pairs, adjacency slots)
_COUNT = "decimal(38,0)"


def credits(principals: DataFrame, *, title: str = "tconst", person: str = "nconst",
            role: str = "category", roles: str | Sequence[str] | None = None) -> DataFrame:
    """(title, person) credit rows of the chosen roles; duplicates are kept (bag).

    A row without a title or without a person links nobody and is dropped.
    """
    cond = F.col(title).isNotNull() & F.col(person).isNotNull()
    rc = role_filter(role, roles)
    if rc is not None:
        cond = cond & rc
    return principals.where(cond).select(F.col(title).alias("title"), F.col(person).alias("person"))


def bipartite_edges(credit_rows: DataFrame) -> DataFrame:
    """Distinct (title, person) pairs: the graph in bipartite form."""
    return credit_rows.select("title", "person").distinct()


def title_sizes(credit_rows: DataFrame) -> DataFrame:
    """(title, n_credits); map-side partial counts, so a huge title costs one row per task."""
    return credit_rows.groupBy("title").agg(F.count(F.lit(1)).alias("n_credits"))


def cast_lists(credit_rows: DataFrame, chunk_size: int = 100_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Persons of each title: (title, chunk, persons, counts).

    ``persons`` is sorted and distinct; ``counts[i]`` is how many credit rows
    ``persons[i]`` has on the title, so repeating each person by its count gives
    the title's full credit list (a bag). Credits are first counted per
    (title, person) with a map-side partial count, so copies of one credit — even
    a third of all rows — collapse into one entry instead of one list slot each.

    ``chunk_size`` is part of the output's form: every title has
    ``ceil(n_persons / chunk_size)`` chunks, to which a stable hash of the person
    deals its persons, so no task holds an unbounded list. A title of at most
    ``chunk_size`` persons has the one chunk 0. A title with more than ``hot_rows`` credits
    meets its number of chunks in several tasks.
    """
    per = credit_rows.groupBy("title", "person").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("title").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk_size)).cast("bigint").alias("n_chunks"))
    rows = skew_join(per, sizes, "title", spread_by=["person"], hot=hot_keys(credit_rows, "title", hot_rows=hot_rows)).select(
        "title", stable_bucket("person", F.col("n_chunks")).alias("chunk"), F.struct("person", "c").alias("pc"))
    grouped = rows.groupBy("title", "chunk").agg(F.array_sort(F.collect_list("pc")).alias("pcs"))
    return grouped.select("title", "chunk", F.col("pcs.person").alias("persons"), F.col("pcs.c").alias("counts"))


def title_pair_stats(credit_rows: DataFrame) -> DataFrame:
    """Per title, the sizes of its co-appearance pair sets, without listing pairs.

    * ``n_credits`` / ``n_persons`` — credit rows and distinct persons.
    * ``combo_pairs`` — distinct unordered 2-combinations of the cast list taken
      as a multiset: C(n_persons, 2) different-person pairs plus one self-pair
      for each person credited at least twice.
    * ``directed_pairs`` — ordered pairs of different list positions,
      n_credits · (n_credits − 1): the bag of directed edges the title emits.
    """
    per = credit_rows.groupBy("title", "person").agg(F.count(F.lit(1)).alias("c"))
    # pair counts grow with the square of a title's size: a title holding a third
    # of 10^12 credits has ~10^23 pairs, beyond bigint, so they are exact decimals
    n = F.col("n_credits").cast(_COUNT)
    d = F.col("n_persons").cast(_COUNT)
    return per.groupBy("title").agg(
        F.sum("c").alias("n_credits"),
        F.count(F.lit(1)).alias("n_persons"),
        F.sum(F.when(F.col("c") >= 2, 1).otherwise(0)).alias("n_repeated"),
    ).select(
        "title", "n_credits", "n_persons",
        (d * (d - 1) / 2 + F.col("n_repeated")).cast(_COUNT).alias("combo_pairs"),
        (n * (n - 1)).cast(_COUNT).alias("directed_pairs"),
    )


def neighbour_slots(credit_rows: DataFrame, source, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Initial BFS state per person: (person, distance, n_neighbours).

    ``n_neighbours`` is the length of the person's adjacency bag — for each of
    the person's credits, the other credits of that title — so duplicates count.
    Persons without any co-credit have no adjacency and are left out.
    ``distance`` is 0 for ``source`` and ``UNREACHED`` otherwise. A title with more
    than ``hot_rows`` credits meets its size in several tasks.
    """
    # credits counted per (title, person) first: copies of one credit collapse
    # map-side before any shuffle; a person's slots are sum(c · (n_title − 1))
    per = credit_rows.groupBy("title", "person").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("title").agg(F.sum("c").alias("n_credits"))
    j = skew_join(per, sizes, "title", spread_by=["person"], hot=hot_keys(credit_rows, "title", hot_rows=hot_rows))
    # exact decimal: one credit duplicated a third of all rows in a huge title
    # would give ~10^23 neighbour slots, beyond bigint
    slots = F.col("c").cast(_COUNT) * (F.col("n_credits") - 1).cast(_COUNT)
    out = j.groupBy("person").agg(F.sum(slots).cast(_COUNT).alias("n_neighbours")) \
        .where(F.col("n_neighbours") > 0)
    src = F.lit(source).cast(credit_rows.schema["person"].dataType)
    dist = F.when(F.col("person") == src, F.lit(0)).otherwise(F.lit(UNREACHED)).cast(IntegerType())
    return out.select("person", dist.alias("distance"), "n_neighbours")


def graph_nodes(credit_rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Persons with at least one co-credit (a title with ≥ 2 credit rows)."""
    sizes = title_sizes(credit_rows).where(F.col("n_credits") >= 2).select("title")
    return skew_join(credit_rows, sizes, "title", "left_semi", spread_by=["person"], hot_rows=hot_rows).select("person").distinct()


_BUCKET_ROWS = 250_000      # edges of a bucket at least, up to as many buckets as the session has shuffle partitions


class _Index:
    """The edges as two tables in the shared folder, bucketed and sorted by person and by title.

    Keys with more than ``hot_rows`` edges are split by salts, found by one sketch of each column; a graph of fewer edges
    than that has none, so its tables are laid out by the key alone.
    """

    def __init__(self, edges: DataFrame, n_edges: int, hot_rows: int):
        spark = edges.sparkSession
        self.n_edges = n_edges
        self.buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000, -(-n_edges // _BUCKET_ROWS)))
        self.session = bucket_session(spark, self.buckets)
        self.hot = {}

        def lay_out(key: str, other: str) -> str:
            hot = None
            if n_edges > hot_rows:
                path = scratch_path(spark, f"hot_{key}")
                hot, _ = staged(hot_keys(edges, key, hot_rows=hot_rows), path)     # HOT_KEYS rows at most
                self.hot[key] = self.session.read.schema(hot.schema).parquet(path)
            laid = edges if hot is None else with_salt(edges, [key], hot, [other])
            return bucketed(laid, [key] if hot is None else [key, "salt"], self.buckets)
        with ThreadPoolExecutor(2) as pool:                # the two tables are written side by side
            both = {k: pool.submit(lay_out, k, o) for k, o in (("person", "title"), ("title", "person"))}
        self.names = {k: x.result() for k, x in both.items()}

    def table(self, key: str) -> DataFrame:
        return self.session.table(self.names[key])

    def lookup(self, key: str, other: str, keys: str) -> str:
        """SQL for the distinct ``other`` of edges whose ``key`` is in the relation ``keys``: only keys and finds move.

        Nulls are left out here and not by what reads it, so that all readers share one exchange."""
        if key not in self.hot:
            return (f"SELECT DISTINCT e.{other} FROM {self.names[key]} e LEFT SEMI JOIN {keys} k ON e.{key} = k.{key} "
                    f"WHERE e.{other} IS NOT NULL")
        asked = (f"SELECT /*+ BROADCAST(h) */ k.{key}, explode(sequence(0, coalesce(h.salts, 1) - 1)) AS salt "
                 f"FROM {keys} k LEFT JOIN {{hot_{key}}} h ON xxhash64(k.{key}) = h.hot_key")
        return (f"SELECT DISTINCT e.{other} FROM {self.names[key]} e LEFT SEMI JOIN ({asked}) k ON e.{key} = k.{key} AND e.salt = k.salt "
                f"WHERE e.{other} IS NOT NULL")

    def drop(self) -> None:
        for name in self.names.values():
            self.session.sql(f"DROP TABLE IF EXISTS {name}")


def bfs_distances(edges: DataFrame, source, *, max_depth: int | None = None, hot_rows: int = HOT_ROWS,
                  small_rows: int = 1_000_000, hops: int = 4, distinct_edges: bool = False) -> DataFrame:
    """Single-source breadth-first distances on the bipartite graph.

    ``edges`` holds (title, person). Returns (person, distance) for every person
    reached within ``max_depth`` hops (all reachable persons when None). The
    source is always in the result with distance 0, even when absent from the data.

    * The edges are written twice to the shared folder, bucketed and sorted by person and by title. A hop
      person → title → person shuffles the keys it looks up and what it found, distinct per task first; the tables are
      neither shuffled nor sorted, and a lost executor reads its buckets again.
    * One job takes several hops while the frontier is small: W[i], the persons at the end of a walk of i hops from
      level d, are all persons of level d + i and others nearer by. The least distance over W[1] … W[h] and the
      known levels d - h … d is exact, and those above d are new levels. With the frontier grown so that
      ``hops`` hops would find more than ``small_rows`` persons, a job takes fewer, down to one.
    * Once most persons are reached the search turns round: the tables are rebuilt from the edges of the unreached
      persons and of the frontier alone, so hops look only at who is still to be found. That happens each time
      those are at most half of the persons in tables of more than ``small_rows`` edges, so all rebuilding together
      writes no more than the tables held at first.
    * Each job's levels are written to the shared folder, with their counts observed as they are written; only
      counts reach the driver.

    ``distinct_edges``: ``edges`` is already a deduplicated, written table.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    ptype = edges.schema["person"].dataType
    e = edges.select("title", "person")
    if distinct_edges:
        n_edges = e.count()
    else:
        e, got = staged(e.distinct(), n=F.count(F.lit(1)))
        n_edges = got["n"]
    first = scratch_path(spark, "level")
    spark.createDataFrame([(None if source is None else str(source),)], "person string").select(
        F.col("person").cast(ptype).alias("person"), F.lit(0).alias("distance")).coalesce(1).write.parquet(first)
    index = _Index(e, n_edges, hot_rows)
    try:
        n_persons = None                                    # in the index; counted when first needed
        levels = [(first, 0, 0)]                            # written tables of (person, distance), and their distances
        depth, n_front, n_before, n_reached = 0, 1, 0, 1
        while n_front and (max_depth is None or depth < max_depth):
            if index.n_edges > small_rows and depth:
                n_persons = n_persons or index.table("person").agg(F.approx_count_distinct("person")).first()[0]
                left = max(n_persons - n_reached, 0) + n_front
                if 2 * left <= n_persons:
                    index, n_persons, n_reached = _turned(spark, index, levels, depth, hot_rows), left, n_front
            h = _hops(hops, n_front, n_before, small_rows if index.n_edges > small_rows else None)
            h = h if max_depth is None else min(h, max_depth - depth)
            path = scratch_path(spark, "level")
            _, got = staged(_reach(index, levels, depth, h), path, n=F.count(F.lit(1)), last=F.count_if(F.col("distance") == depth + h),
                            before=F.count_if(F.col("distance") == depth + h - 1))
            if not got["n"]:
                break
            levels.append((path, depth + 1, depth + h))
            n_before = got["before"] if h > 1 else n_front
            depth, n_front, n_reached = depth + h, got["last"], n_reached + got["n"]
    finally:
        index.drop()
    return _read_levels(spark, [x for x, _, _ in levels], ptype)


def _read_levels(spark, paths: list[str], ptype) -> DataFrame:
    return spark.read.schema(StructType([StructField("person", ptype), StructField("distance", IntegerType())])).parquet(*paths)


def _hops(most: int, n_front: int, n_before: int, bound: int | None) -> int:
    """Hops of the next job: ``most`` on a small graph (no bound); else as many as keep what is found within it, if the
    frontier goes on growing as it did."""
    if bound is None:
        return most
    growth = max(2.0, n_front / max(n_before, 1)) if n_before else 100.0
    h, n = 1, n_front * growth
    while h < most and n * growth <= bound:
        h, n = h + 1, n * growth
    return h


def _reach(index: _Index, levels: list[tuple[str, int, int]], depth: int, h: int) -> DataFrame:
    """(person, distance) of levels depth + 1 … depth + h. As one statement: a name used twice is read from one exchange."""
    ptype = index.table("person").schema["person"].dataType
    frames = {"known": _read_levels(index.session, [x for x, _, high in levels if high >= depth - h], ptype)}
    frames |= {f"hot_{k}": x for k, x in index.hot.items()}
    steps = [f"near AS (SELECT person, distance FROM {{known}} WHERE distance >= {depth - h})", f"w0 AS (SELECT person FROM near WHERE distance = {depth})"]
    for i in range(1, h + 1):
        steps += [f"t{i} AS ({index.lookup('person', 'title', f'w{i - 1}')})", f"w{i} AS ({index.lookup('title', 'person', f't{i}')})"]
    found = " UNION ALL ".join(["SELECT * FROM near", *[f"SELECT person, {depth + i} AS distance FROM w{i}" for i in range(1, h + 1)]])
    return index.session.sql(f"WITH {', '.join(steps)} SELECT person, min(distance) AS distance FROM ({found}) "
                             f"GROUP BY person HAVING min(distance) > {depth}", **frames)


def _turned(spark, index: _Index, levels: list[tuple[str, int, int]], depth: int, hot_rows: int) -> _Index:
    """The index of what is left: edges of persons who are on the frontier or not reached yet."""
    edges = index.table("person").select("title", "person")
    done = _read_levels(index.session, [x for x, _, _ in levels], edges.schema["person"].dataType).where(F.col("distance") < depth)
    path = scratch_path(spark, "edges")
    rest, got = staged(edges.join(done.select("person"), "person", "left_anti"), path, n=F.count(F.lit(1)))
    out = _Index(spark.read.schema(rest.schema).parquet(path), got["n"], hot_rows)
    index.drop()
    return out


def bfs_distances_capped(credit_rows: DataFrame, source, max_depth: int = 6,
                         unreached: int = UNREACHED, **kw) -> DataFrame:
    """Depth-limited distances over every person with a co-credit.

    Persons farther than ``max_depth`` hops, or not connected to ``source``,
    get ``unreached``. Persons without any co-credit are absent; so is the
    source when it has none (then every listed person is ``unreached``).
    """
    # distinct edges with their credit counts, and from them the nodes: persons with more titles than those of which
    # they have the only credit row. Such a title's one person comes from its aggregate, so no edge is joined.
    per_pair, _ = staged(credit_rows.groupBy("title", "person").agg(F.count(F.lit(1)).alias("c")))
    titled = per_pair.where(F.col("title").isNotNull())
    lone = titled.groupBy("title").agg(F.sum("c").alias("n"), F.min("person").alias("person")).where(F.col("n") == 1)
    nodes = (titled.select("person", F.lit(1).alias("one")).unionByName(lone.select("person", F.lit(-1).alias("one")))
             .groupBy("person").agg(F.sum("one").alias("shared")).where(F.col("shared") > 0).select("person"))
    dist = bfs_distances(per_pair, source, max_depth=max_depth, distinct_edges=True, **kw)
    return (nodes.join(dist, "person", "left")
            .select("person", F.coalesce(F.col("distance"), F.lit(unreached)).cast(IntegerType()).alias("distance")))


def level_histogram(distances: DataFrame) -> DataFrame:
    """(distance, n_nodes) — how many persons at each distance."""
    return distances.groupBy("distance").agg(F.count(F.lit(1)).alias("n_nodes"))


def gather_distances(distances: DataFrame) -> DataFrame:
    """(person, distances): all distance values per person as a sorted list."""
    return distances.groupBy("person").agg(F.array_sort(F.collect_list("distance")).alias("distances"))
