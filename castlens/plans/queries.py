"""Named queries over the driver tables: ``(spark, sf_dir) -> DataFrame``.

Every query reads whole tables (no id subsets, no row caps). Queries that
exercise a source or sink write a copy of a driver table in that format into a
fresh folder under the shared checkpoint folder, and return the DataFrame read
back from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from castlens.constants import HEADER_KEY
from castlens.functions.columns import array_get, concat_key, safe_double, split_get, word_tokens
from castlens.operators import graph as G
from castlens.operators.adjacency import compressed_rows, decoded, neighbours
from castlens.operators.bitmaps import bitmap_difference, bitmap_intersection, bitmap_members, distinct_counts
from castlens.operators.incremental import add_batch, compact_states, metric_states, read_states, state_averages
from castlens.operators.joins import staged
from castlens.operators.partitions import partition_summary, repartition
from castlens.operators.ratings import average_metric_per_person
from castlens.operators.shaping import (first_n, rename_add_drop, replicate, set_difference,
                                        union_all, union_by_name, with_key, with_midpoint,
                                        with_sql_columns)
from castlens.operators.text import word_count
from castlens.operators.variants import read_variant_lines, variant_columns, variant_profile
from castlens.plans.tables import (ACTING_ROLES, BFS_DEPTH, BFS_SOURCE, CHUNK_SIZE, GRAPH_ROLES,
                                   MONEY_SCALE, REPLICAS, SINGLE_ROLE, SMALL_CHUNK, principals, ratings,
                                   table)
from castlens.session import scratch_path
from castlens.sources.lines import number_lines, read_quarantined
from castlens.streaming.ingest import stage_stream
from castlens.sources.readers import (read_csv_clean, read_csv_inferred, read_delimited, read_json,
                                      read_text_positional, unescape)
from castlens.sources.sinks import (stage_to_parquet, write_delimited, write_keyvalue,
                                    write_text_rows)

Query = Callable[[SparkSession, str], DataFrame]


# --------------------------------------------------------------------------- ratings

def avg_metric_role_set(spark, sf_dir):
    return average_metric_per_person(
        principals(spark, sf_dir, ACTING_ROLES), ratings(spark, sf_dir), roles=None,
        exact_scale=MONEY_SCALE)


def avg_metric_single_role(spark, sf_dir):
    return average_metric_per_person(
        principals(spark, sf_dir, SINGLE_ROLE), ratings(spark, sf_dir), roles=None,
        exact_scale=MONEY_SCALE)


def avg_metric_all_roles(spark, sf_dir):
    # every role; one rating per title (the last by rated_at), as a lookup join
    return average_metric_per_person(
        principals(spark, sf_dir), ratings(spark, sf_dir), roles=None,
        dedupe_order_by="rated_at", exact_scale=MONEY_SCALE)


def avg_metric_role_filter(spark, sf_dir):
    # same question with the role filter applied by the operator on `category`
    return average_metric_per_person(
        principals(spark, sf_dir), ratings(spark, sf_dir), roles=["AO", "RO"],
        exact_scale=MONEY_SCALE)


def avg_metric_text_side_file(spark, sf_dir):
    """The line-oriented variant: credits and ratings as raw text lines split by
    position, header lines skipped wherever they occur (the ratings side file by
    prefix), rating text parsed leniently; every role, ratings as a lookup side.
    The side file rates every title twice, a wrong rating on the line before the
    right one, and the last line of a title wins."""
    credits_path = scratch_path(spark, "principals_lines")
    write_delimited(principals(spark, sf_dir), credits_path)
    ratings_path = scratch_path(spark, "ratings_lines")
    twice = F.explode(F.array(F.col("averageRating") + 1000, F.col("averageRating")))
    write_delimited(ratings(spark, sf_dir).select("tconst", twice.alias("averageRating")), ratings_path)
    cr = read_text_positional(spark, credits_path, {"tconst": 0, "nconst": 2},
                              header_field="tconst", header_value=HEADER_KEY)
    rt = read_text_positional(spark, ratings_path, {"tconst": 0, "rating": 1},
                              header_prefix=HEADER_KEY, strip=True, line_order="line")
    rt = rt.select("tconst", safe_double("rating").alias("averageRating"), "line")
    return average_metric_per_person(cr, rt, roles=None, exact_scale=MONEY_SCALE, dedupe_order_by="line")


# --------------------------------------------------------------------------- graph

def _credits(spark, sf_dir, roles=None):
    return principals(spark, sf_dir, roles).transform(G.credits)


def cast_list_per_title(spark, sf_dir):
    return G.cast_lists(_credits(spark, sf_dir, ACTING_ROLES), chunk_size=CHUNK_SIZE)


def cast_list_per_title_chunked(spark, sf_dir):
    # lists of about four persons: most titles have several chunks
    return G.cast_lists(_credits(spark, sf_dir), chunk_size=SMALL_CHUNK)


def title_pair_stats(spark, sf_dir):
    return G.title_pair_stats(_credits(spark, sf_dir, ACTING_ROLES))


def neighbour_slots(spark, sf_dir):
    return G.neighbour_slots(_credits(spark, sf_dir), BFS_SOURCE)


def bfs_distance_full(spark, sf_dir):
    return (_credits(spark, sf_dir, GRAPH_ROLES)
            .transform(G.bipartite_edges)
            .transform(G.bfs_distances, BFS_SOURCE))


def bfs_distance_full_acting_roles(spark, sf_dir):
    # the acting role set, to exhaustion: the DataFrame search's exact form
    return _credits(spark, sf_dir, ACTING_ROLES).transform(G.bipartite_edges).transform(G.bfs_distances, BFS_SOURCE)


def bfs_distance_full_all_roles(spark, sf_dir):
    return _credits(spark, sf_dir).transform(G.bipartite_edges).transform(G.bfs_distances, BFS_SOURCE)


def bfs_distance_full_indexed(spark, sf_dir):
    """The all-roles search with a salt for every four edges of the most frequent persons and titles, few hops
    a job, and tables rebuilt from the unreached persons as soon as they are the fewer."""
    return _credits(spark, sf_dir).transform(G.bipartite_edges).transform(
        G.bfs_distances, BFS_SOURCE, hot_rows=4, small_rows=100, hops=2)


def bfs_distance_capped(spark, sf_dir):
    return G.bfs_distances_capped(_credits(spark, sf_dir, GRAPH_ROLES), BFS_SOURCE, max_depth=BFS_DEPTH)


def bfs_distance_capped_all_roles(spark, sf_dir):
    # every role, depth-limited, sentinel for the rest: the line-oriented job's exact form
    return G.bfs_distances_capped(_credits(spark, sf_dir), BFS_SOURCE, max_depth=BFS_DEPTH)


def bfs_level_histogram(spark, sf_dir):
    return bfs_distance_full(spark, sf_dir).transform(G.level_histogram)


def bfs_distance_gathered(spark, sf_dir):
    return bfs_distance_capped(spark, sf_dir).transform(G.gather_distances)


# --------------------------------------------------------------------------- text

def word_count_documents(spark, sf_dir):
    return word_count(table(spark, sf_dir, "documents").select("text"), "text")


# --------------------------------------------------------------------------- sources / sinks

PRINCIPALS_TYPED = StructType([
    StructField("tconst", LongType(), True),
    StructField("ordering", IntegerType(), True),
    StructField("nconst", LongType(), True),
    StructField("category", StringType(), True),
    StructField("job", StringType(), True),
])


def scan_tsv_schema(spark, sf_dir):
    path = scratch_path(spark, "principals_tsv")
    write_delimited(principals(spark, sf_dir), path)
    return read_delimited(spark, path, PRINCIPALS_TYPED)


def stage_to_parquet_q(spark, sf_dir):
    raw = scratch_path(spark, "principals_raw")
    write_delimited(principals(spark, sf_dir), raw)
    return stage_to_parquet(spark, raw, PRINCIPALS_TYPED, scratch_path(spark, "principals_parquet"))


def scan_text_positional(spark, sf_dir):
    path = scratch_path(spark, "principals_lines")
    write_delimited(principals(spark, sf_dir), path)   # one header line per part file
    df = read_text_positional(spark, path, {"tconst": 0, "ordering": 1, "nconst": 2},
                              header_field="tconst", header_value=HEADER_KEY)
    return df.select("tconst", "nconst", F.col("ordering").try_cast("int").alias("ordering"))


def scan_csv_infer(spark, sf_dir):
    path = scratch_path(spark, "customer_csv")
    table(spark, sf_dir, "customer").write.mode("overwrite").option("header", "true").csv(path)
    return read_csv_inferred(spark, path)


def scan_csv_clean(spark, sf_dir):
    """A dirty CSV like a hand-exported sheet: unnamed index column, padded
    values, a quoted comma inside a value, CRLF line ends."""
    path = scratch_path(spark, "supplier_dirty_csv")
    s = table(spark, sf_dir, "supplier")
    dirty = s.select(
        F.col("s_suppkey").alias(""),
        F.concat(F.col("s_name"), F.lit(", Ltd ")).alias("name"),
        F.concat(F.lit(" N"), F.col("s_nationkey").cast("string")).alias("nation"),
        F.col("s_acctbal").alias("acctbal"),
        F.col("s_suppkey").alias("id"),
    )
    dirty.write.mode("overwrite").option("header", "true").option("lineSep", "\r\n") \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return read_csv_clean(spark, path, index_name="row_index")


def _nested_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.struct("event_id", "user_id", F.concat(F.col("event_type"), F.lit(" - "), F.col("event_type"))
                 .alias("kind_path")).alias("body"),
        F.array(F.col("value"), F.col("user_id").cast("double")).alias("measures"),
    )


def scan_json_nested(spark, sf_dir):
    """Events as nested JSON records (struct + array), read back with an
    inferred schema and flattened by path."""
    path = scratch_path(spark, "events_json")
    nested = _nested_events(spark, sf_dir)
    nested.write.mode("overwrite").json(path)
    return _flat_events(read_json(spark, path))


def scan_json_declared(spark, sf_dir):
    """The same records with a declared schema: no inference pass."""
    path = scratch_path(spark, "events_json_declared")
    _nested_events(spark, sf_dir).write.mode("overwrite").json(path)
    return _flat_events(read_json(
        spark, path, "body STRUCT<event_id BIGINT, user_id BIGINT, kind_path STRING>, measures ARRAY<DOUBLE>"))


def _flat_events(df):
    return df.select(
        F.col("body.event_id").alias("event_id"),
        F.col("body.user_id").alias("user_id"),
        split_get("body.kind_path", " - ", 1).alias("type"),
        split_get("body.kind_path", " - ", 2).alias("subtype"),
        array_get("measures", 0).alias("amount"),
        array_get("measures", 1).alias("actor"),
        array_get("measures", 2).alias("extra"),
    )


def sink_text_rows(spark, sf_dir):
    path = scratch_path(spark, "title_sizes_txt")
    sizes = G.title_sizes(G.credits(principals(spark, sf_dir)))
    write_text_rows(sizes, path, ["title", "n_credits"], style="list",
                    sort_by=[F.col("n_credits").desc(), F.col("title")])
    return spark.read.text(path)


def sink_tuple_rows(spark, sf_dir):
    path = scratch_path(spark, "bfs_txt")
    write_text_rows(bfs_distance_capped(spark, sf_dir), path, ["person", "distance"], style="tuple")
    return spark.read.text(path)


def sink_keyvalue_overwrite(spark, sf_dir):
    path = scratch_path(spark, "word_count_kv")
    wc = word_count_documents(spark, sf_dir)
    write_keyvalue(wc, path, "word", "count")
    write_keyvalue(wc, path, "word", "count", mode="overwrite")   # a rerun replaces the output
    kv = read_text_positional(spark, path, {"word": 0, "count": 1})
    return kv.select(unescape("word").alias("word"), F.col("count").cast("bigint").alias("count"))


def sink_text_round_trip(spark, sf_dir):
    """Free text (newlines, tabs, blanks at the ends, backslashes) through the delimited writer and back."""
    path = scratch_path(spark, "documents_tsv")
    d = table(spark, sf_dir, "documents")
    odd = F.concat(F.lit(" \t\\"), F.col("text"), F.lit("\\N\r\n "))
    write_delimited(d.select("doc_id", "text", odd.alias("odd"), F.lit("").alias("empty"), F.lit("\\N").alias("marker")), path)
    return read_delimited(spark, path, "doc_id BIGINT, text STRING, odd STRING, empty STRING, marker STRING", escaped=True)


def sink_json_keyvalue(spark, sf_dir):
    """Gathered capped distances as JSON key-value lines (``0<TAB>[3]``), read back as text."""
    path = scratch_path(spark, "bfs_json_kv")
    write_keyvalue(bfs_distance_gathered(spark, sf_dir), path, "person", "distances", json=True)
    return spark.read.text(path)


def subset_first_n(spark, sf_dir):
    p = principals(spark, sf_dir).select("tconst", "ordering", "nconst", "category")
    return first_n(p, 20, ["tconst", "ordering", "nconst", "category"])


def partition_skew_report_q(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return partition_summary(principals(spark, sf_dir), n, ["tconst"])


# --------------------------------------------------------------------------- shaping

def concat_key_q(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return with_key(c.select("c_custkey", "c_mktsegment", "c_nationkey"), "id",
                    "c_mktsegment", F.lit("_"), F.lit("cust"), F.lit("_"), "c_custkey")


def rename_add_drop_q(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rename_add_drop(
        c, renames={"c_custkey": "party_key", "c_name": "name", "c_nationkey": "nation",
                    "c_acctbal": "balance", "c_mktsegment": "type"},
        constants={"origin": "customer"}, null_columns={"closed_on": "string"}, drop=["balance"])


def derived_midpoint(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_discount").alias("low"), F.col("l_tax").alias("high"))
    return with_midpoint(li, "low", "high", "mid", copies={"low_copy": "low", "high_copy": "high"})


def split_get_item(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", split_get("c_name", "#", 0).alias("prefix"),
                    split_get("c_name", "#", 1).alias("number"),
                    split_get("c_name", "#", 2).alias("missing"))


def array_get_item(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", array_get("embedding", 0).alias("x0"), array_get("embedding", 1).alias("x1"),
                    F.get(F.col("embedding"), F.size("embedding")).alias("past_end"))


def json_nested_extract(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    props = F.from_json(F.col("props"), "k BIGINT")
    return ev.select("event_id", props.getField("k").alias("k"))


def _common_parties(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    cust = rename_add_drop(
        c, renames={"c_custkey": "party_key", "c_name": "name", "c_nationkey": "nation",
                    "c_acctbal": "balance"},
        constants={"origin": "customer"}, null_columns={"closed_on": "string"}, drop=["c_mktsegment"])
    supp = rename_add_drop(
        s.select("s_acctbal", "s_nationkey", "s_name", "s_suppkey"),   # other column order on purpose
        renames={"s_suppkey": "party_key", "s_name": "name", "s_nationkey": "nation",
                 "s_acctbal": "balance"},
        constants={"origin": "supplier"}, null_columns={"closed_on": "string"})
    u = union_by_name([cust, supp], to_string=["party_key"])
    return u.withColumn("id", concat_key("origin", F.lit("_"), "party_key"))


def union_by_name_q(spark, sf_dir):
    return _common_parties(spark, sf_dir)


def union_csv_json(spark, sf_dir):
    """Two differently shaped sources brought to common columns and unioned by
    name: parties from an inferred-type CSV and from nested JSON records."""
    csv_path = scratch_path(spark, "customers_csv")
    table(spark, sf_dir, "customer").write.mode("overwrite").option("header", "true").csv(csv_path)
    json_path = scratch_path(spark, "suppliers_json")
    s = table(spark, sf_dir, "supplier")
    s.select(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"),
                      F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")).alias("body"),
             F.col("s_suppkey").cast("string").alias("ref")) \
        .write.mode("overwrite").json(json_path)
    cust = rename_add_drop(
        read_csv_inferred(spark, csv_path),
        renames={"c_custkey": "party_key", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance"},
        constants={"origin": "customer"}, null_columns={"closed_on": "string"}, drop=["c_mktsegment"])
    cust = repartition(cust, int(spark.conf.get("spark.sql.shuffle.partitions")))
    j = read_json(spark, json_path)
    supp = j.select(
        F.col("body.id").alias("party_key"), F.col("body.label").alias("name"),
        F.col("body.nation").cast("int").alias("nation"), F.col("body.balance").alias("balance"),
        F.lit("supplier").alias("origin"), F.lit(None).cast("string").alias("closed_on"))
    u = union_by_name([cust, supp], to_string=["party_key"])
    return u.withColumn("id", concat_key("origin", F.lit("_"), "party_key"))


def union_by_name_count(spark, sf_dir):
    return _common_parties(spark, sf_dir).groupBy("origin").agg(F.count(F.lit(1)).alias("n_rows"))


def union_replicate(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("low"), F.col("s_nationkey").cast("double").alias("high"))
    rep = replicate(s, REPLICAS, copy_col="copy")
    return with_midpoint(rep, "low", "high", "mid", copies={"low_copy": "low", "high_copy": "high"})


def union_positional(spark, sf_dir):
    """Positional union of a table with itself, then renames and SQL-expression
    columns on top (one scan per union input, projections collapsed)."""
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nation"))
    u = union_all([s, s]).withColumnsRenamed({"s_acctbal": "low", "s_nation": "high"})
    return with_sql_columns(u, {"mid": "(low + high) / 2", "low_copy": "low", "high_copy": "high"})


def stream_stage_to_parquet(spark, sf_dir):
    landing = scratch_path(spark, "landing")
    write_delimited(principals(spark, sf_dir), landing)
    return stage_stream(spark, landing, PRINCIPALS_TYPED, scratch_path(spark, "staged"))


def set_difference_q(spark, sf_dir):
    graph_titles = principals(spark, sf_dir, GRAPH_ROLES).select("tconst")
    single_titles = principals(spark, sf_dir, SINGLE_ROLE).select("tconst")
    return set_difference(graph_titles, single_titles)


def bitmap_set_difference(spark, sf_dir):
    """The same difference over 4 KB bitmaps of title keys."""
    return bitmap_difference(principals(spark, sf_dir, GRAPH_ROLES).select("tconst"),
                             principals(spark, sf_dir, SINGLE_ROLE).select("tconst"), "tconst")


def bitmap_membership(spark, sf_dir):
    """Credits of the graph roles on titles that the single role has a credit on too."""
    return bitmap_members(principals(spark, sf_dir, GRAPH_ROLES).select("tconst", "nconst", "ordering"),
                          principals(spark, sf_dir, SINGLE_ROLE).select("tconst"), "tconst", spread_by=["nconst", "ordering"])


def bitmap_distinct_persons(spark, sf_dir):
    return distinct_counts(principals(spark, sf_dir), "nconst", ["category"]).withColumnRenamed("n", "n_persons")


def bitmap_common_persons(spark, sf_dir):
    """Persons with credits in both the single role and the graph roles."""
    return bitmap_intersection(principals(spark, sf_dir, GRAPH_ROLES).select("nconst"),
                               principals(spark, sf_dir, SINGLE_ROLE).select("nconst"), "nconst")


def _credit_lines(spark, sf_dir):
    """Credits as text lines in many files whose order is that of (title, ordering, person, role)."""
    path = scratch_path(spark, "ordered_lines")
    order = ["tconst", "ordering", "nconst", "category"]
    rows = principals(spark, sf_dir).repartitionByRange(16, *order).sortWithinPartitions(*order)
    rows.select(F.concat_ws("\t", *order).alias("value")).write.text(path)
    return path


def line_numbers(spark, sf_dir):
    return number_lines(spark, _credit_lines(spark, sf_dir)).select("line_no", "value")


def subset_first_lines(spark, sf_dir):
    """head -n over many files (the first 1,000 lines are the feature)."""
    return number_lines(spark, _credit_lines(spark, sf_dir), first=1000).select("line_no", "value")


def scan_quarantine(spark, sf_dir):
    """Credits as lines beside a broken line for every supplier: rows that parse and lines that don't, per kind."""
    path = scratch_path(spark, "dirty_lines")
    good = principals(spark, sf_dir).select(F.concat_ws("\t", "tconst", "ordering", "nconst", "category").alias("value"))
    s = table(spark, sf_dir, "supplier")
    broken = s.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws("\t", "s_suppkey", F.lit("first"), F.lit("7"), F.lit("AF")))
                      .when(F.col("s_suppkey") % 3 == 1, F.concat_ws("\t", "s_suppkey", F.lit("1")))
                      .otherwise(F.concat_ws("\t", "s_suppkey", F.lit("1"), F.lit("7"), F.lit("AF"), F.lit("more"))).alias("value"))
    good.unionByName(broken).write.text(path)
    rows, bad = read_quarantined(spark, path, StructType.fromDDL("tconst bigint, ordering int, nconst bigint, category string"))
    key = F.try_to_number(F.split_part("value", F.lit("\t"), F.lit(1)), F.lit("9999999999")).cast("long")
    return rows.agg(F.lit("row").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("tconst").alias("keys")).unionByName(
        bad.agg(F.lit("line").alias("kind"), F.count("line").alias("n"), F.sum(key).alias("keys")))


def avg_metric_incremental(spark, sf_dir):
    """Averages over all roles from three landing batches: one replayed before and one after it was merged."""
    path, credits, rated = scratch_path(spark, "average_states"), principals(spark, sf_dir), ratings(spark, sf_dir)

    def land(batch):
        part = credits.where(F.pmod(F.col("ordering"), F.lit(3)) == batch)
        add_batch(metric_states(part, rated, exact_scale=MONEY_SCALE), batch, path)
    land(0)
    land(1)
    land(1)
    compact_states(spark, path)
    land(0)
    land(2)
    return state_averages(read_states(spark, path), exact_scale=MONEY_SCALE)


def adjacency_round_trip(spark, sf_dir):
    """Casts of all titles as compressed rows of at most four persons, decoded again."""
    casts = compressed_rows(G.credits(principals(spark, sf_dir)), "title", "person", chunk_keys=SMALL_CHUNK)
    return decoded(casts, "person", ["title"])


def adjacency_chunk_report(spark, sf_dir):
    """Sizes of the compressed titles of each person: titles, span, and whether every chunk keeps its bounds."""
    titles = compressed_rows(G.credits(principals(spark, sf_dir)), "person", "title", chunk_keys=SMALL_CHUNK)
    bounded = (F.col("n") <= SMALL_CHUNK) & (F.octet_length("packed") == F.col("n") * F.col("width"))
    return titles.groupBy("person").agg(F.sum("n").alias("n_titles"), F.min("first").alias("first_title"),
                                        F.max("last").alias("last_title"), F.every(bounded).alias("bounded"))


def neighbours_of_source(spark, sf_dir):
    """Whom the search's source shares titles with, over all roles, read from compressed rows of both directions."""
    c = G.credits(principals(spark, sf_dir))
    titles_of, _ = staged(compressed_rows(c, "person", "title"))
    casts, _ = staged(compressed_rows(c, "title", "person"))
    return neighbours(titles_of, casts, spark.range(BFS_SOURCE, BFS_SOURCE + 1).select(F.col("id").alias("person")))


def _mixed_events(spark, sf_dir):
    """Events as JSON lines in four shapes (nested, flat with numbers as text, array, partly renamed), and a broken
    line for every supplier."""
    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    nested = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")).alias("event"),
                                F.col("event_type").alias("type"), "value", F.struct("k").alias("props")))
    flat = F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("type"), F.col("value").cast("string").alias("value"), "k"))
    listed = F.concat(F.lit("["), F.concat_ws(",", "event_id", "user_id", F.concat(F.lit('"'), "event_type", F.lit('"')),
                                              F.col("value").cast("string"), "k"), F.lit("]"))
    renamed = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")).alias("event"),
                                 F.struct(F.col("event_type").alias("name")).alias("kind"), F.col("value").alias("amount"), F.array("k").alias("props")))
    shape = F.pmod(F.col("event_id"), F.lit(4))
    lines = ev.select(F.when(shape == 0, nested).when(shape == 1, flat).when(shape == 2, listed).otherwise(renamed).alias("value"))
    broken = table(spark, sf_dir, "supplier").select(F.concat(F.lit('{"event_id": '), F.col("s_suppkey")).alias("value"))
    path = scratch_path(spark, "mixed_events")
    lines.unionByName(broken).write.text(path)
    return read_variant_lines(spark, path)


def scan_json_variant(spark, sf_dir):
    """Fields of records in four shapes, by path and type, in one pass without a schema."""
    return variant_columns(_mixed_events(spark, sf_dir), {
        "event_id": ("bigint", ["$.event.id", "$.event_id", "$[0]"]), "user_id": ("bigint", ["$.event.user", "$.user_id", "$[1]"]),
        "event_type": ("string", ["$.type", "$.kind.name", "$[2]"]), "value": ("double", ["$.value", "$.amount", "$[3]"]),
        "k": ("bigint", ["$.props.k", "$.k", "$.props[0]", "$[4]"])})


def json_variant_profile(spark, sf_dir):
    """Which top-level fields the records have, as what, and how many lines are no JSON."""
    lines = _mixed_events(spark, sf_dir)
    bad = lines.where(F.col("bad_line").isNotNull()).agg(F.lit("bad line").alias("key"), F.lit("TEXT").alias("kind"), F.count("bad_line").alias("n"))
    return variant_profile(lines).where(F.col("key").isNotNull()).unionByName(bad)


def safe_cast_count(spark, sf_dir):
    """Text → number with bad text counted instead of failing (the mapper's float()), over every token."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(word_tokens("text")).alias("t")).where(F.col("t") != F.lit(""))
    d = tokens.select(safe_double("t").alias("x"))
    return d.agg(F.count(F.lit(1)).alias("n_tokens"), F.count("x").alias("n_numeric"),
                 (F.count(F.lit(1)) - F.count("x")).alias("n_bad"))


QUERIES: dict[str, Query] = {
    "avg_metric_role_set": avg_metric_role_set,
    "avg_metric_single_role": avg_metric_single_role,
    "avg_metric_all_roles": avg_metric_all_roles,
    "avg_metric_role_filter": avg_metric_role_filter,
    "avg_metric_text_side_file": avg_metric_text_side_file,
    "cast_list_per_title": cast_list_per_title,
    "cast_list_per_title_chunked": cast_list_per_title_chunked,
    "title_pair_stats": title_pair_stats,
    "neighbour_slots": neighbour_slots,
    "bfs_distance_full": bfs_distance_full,
    "bfs_distance_full_acting_roles": bfs_distance_full_acting_roles,
    "bfs_distance_full_all_roles": bfs_distance_full_all_roles,
    "bfs_distance_full_indexed": bfs_distance_full_indexed,
    "bfs_distance_capped": bfs_distance_capped,
    "bfs_distance_capped_all_roles": bfs_distance_capped_all_roles,
    "bfs_level_histogram": bfs_level_histogram,
    "bfs_distance_gathered": bfs_distance_gathered,
    "word_count": word_count_documents,
    "scan_tsv_schema": scan_tsv_schema,
    "stage_to_parquet": stage_to_parquet_q,
    "scan_text_positional": scan_text_positional,
    "scan_csv_infer": scan_csv_infer,
    "scan_csv_clean": scan_csv_clean,
    "scan_json_nested": scan_json_nested,
    "json_nested_extract": json_nested_extract,
    "sink_text_rows": sink_text_rows,
    "sink_tuple_rows": sink_tuple_rows,
    "sink_keyvalue_overwrite": sink_keyvalue_overwrite,
    "sink_json_keyvalue": sink_json_keyvalue,
    "sink_text_round_trip": sink_text_round_trip,
    "scan_json_declared": scan_json_declared,
    "subset_first_n": subset_first_n,
    "partition_skew_report": partition_skew_report_q,
    "concat_key": concat_key_q,
    "rename_add_drop": rename_add_drop_q,
    "derived_midpoint": derived_midpoint,
    "split_get_item": split_get_item,
    "array_get_item": array_get_item,
    "union_by_name": union_by_name_q,
    "union_by_name_count": union_by_name_count,
    "union_csv_json": union_csv_json,
    "union_replicate": union_replicate,
    "union_positional": union_positional,
    "stream_stage_to_parquet": stream_stage_to_parquet,
    "set_difference": set_difference_q,
    "bitmap_set_difference": bitmap_set_difference,
    "bitmap_membership": bitmap_membership,
    "bitmap_distinct_persons": bitmap_distinct_persons,
    "bitmap_common_persons": bitmap_common_persons,
    "line_numbers": line_numbers,
    "subset_first_lines": subset_first_lines,
    "scan_quarantine": scan_quarantine,
    "avg_metric_incremental": avg_metric_incremental,
    "adjacency_round_trip": adjacency_round_trip,
    "adjacency_chunk_report": adjacency_chunk_report,
    "neighbours_of_source": neighbours_of_source,
    "scan_json_variant": scan_json_variant,
    "json_variant_profile": json_variant_profile,
    "safe_cast_count": safe_cast_count,
}
