"""Independent DuckDB SQL for each registered query (same column names/types).

The tables are the driver's parquet views. Graph distances use DuckDB's
``WITH RECURSIVE … USING KEY`` so the oracle search is exact and unbounded:
each step only admits persons not yet in the keyed result.
"""

from __future__ import annotations

from castlens.constants import UNREACHED
from castlens.plans.tables import (ACTING_ROLES, BFS_DEPTH, BFS_SOURCE, CHUNK_SIZE, GRAPH_ROLES,
                                   REPLICAS, SINGLE_ROLE, SMALL_CHUNK)


def _in(roles) -> str:
    if isinstance(roles, str):
        roles = (roles,)
    return "(" + ", ".join(f"'{r}'" for r in roles) + ")"


def _credits(roles=None) -> str:
    where = " WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL"
    if roles is not None:
        where += f" AND l_returnflag || l_linestatus IN {_in(roles)}"
    return f"SELECT l_orderkey AS title, l_partkey AS person FROM lineitem{where}"


def _avg(where: str, dedupe: bool = False) -> str:
    r = ("(SELECT o_orderkey, arg_max(o_totalprice, o_orderdate) AS o_totalprice FROM orders GROUP BY o_orderkey)"
         if dedupe else "orders")
    return f"""
SELECT l.l_partkey AS nconst,
       CAST(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(o.o_totalprice) / 100 AS avgRating
FROM lineitem l JOIN {r} o ON l.l_orderkey = o.o_orderkey
{where}
GROUP BY l.l_partkey
"""


def _bfs(roles, max_depth: int | None) -> str:
    depth = "" if max_depth is None else f"r.distance < {max_depth} AND "
    return f"""
e AS (SELECT DISTINCT title, person FROM ({_credits(roles)})),
r(person, distance) USING KEY (person) AS (
  SELECT CAST({BFS_SOURCE} AS BIGINT), 0
  UNION
  (SELECT e2.person, min(r.distance + 1)
   FROM r JOIN e e1 ON e1.person = r.person JOIN e e2 ON e2.title = e1.title
   WHERE {depth}e2.person NOT IN (SELECT person FROM recurring.r)
   GROUP BY e2.person)
)"""


def _bfs_full(roles) -> str:
    return f"WITH RECURSIVE {_bfs(roles, None)}\nSELECT person, CAST(distance AS INTEGER) AS distance FROM r"


def _bfs_capped_body(roles) -> str:
    return f"""WITH RECURSIVE c AS ({_credits(roles)}),
multi AS (SELECT title FROM c GROUP BY title HAVING count(*) >= 2),
nodes AS (SELECT DISTINCT person FROM c WHERE title IN (SELECT title FROM multi)),
{_bfs(roles, BFS_DEPTH)},
capped AS (SELECT n.person, CAST(coalesce(r.distance, {UNREACHED}) AS INTEGER) AS distance
           FROM nodes n LEFT JOIN r ON n.person = r.person)"""


PRINCIPALS_SQL = """SELECT l_orderkey AS tconst, l_linenumber AS ordering, l_partkey AS nconst,
       l_returnflag || l_linestatus AS category,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag END AS job
FROM lineitem"""

_WORDS = """SELECT w AS word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS w FROM documents) WHERE w <> ''"""

WORD_COUNT_SQL = f"SELECT word, COUNT(*) AS count FROM ({_WORDS}) GROUP BY word"


def _midpoint_cols() -> str:
    return "low, high, (low + high) / 2 AS mid, low AS low_copy, high AS high_copy"


_PARTIES = """SELECT *, origin || '_' || party_key AS id FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS party_key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance,
         'customer' AS origin, CAST(NULL AS VARCHAR) AS closed_on FROM customer
  UNION ALL BY NAME
  SELECT s_acctbal AS balance, s_nationkey AS nation, s_name AS name, CAST(s_suppkey AS VARCHAR) AS party_key,
         'supplier' AS origin, CAST(NULL AS VARCHAR) AS closed_on FROM supplier)"""


def _casts(roles, size: int) -> str:
    return f"""
WITH per AS (SELECT title, person, count(*) AS c FROM ({_credits(roles)}) GROUP BY title, person),
s AS (SELECT title, CAST(ceil(count(*) / {size}) AS BIGINT) AS n_chunks FROM per GROUP BY title)
SELECT per.title, CAST(('0x' || substr(md5(CAST(per.person AS VARCHAR)), 1, 8)) AS BIGINT) % s.n_chunks AS chunk,
       list(per.person ORDER BY per.person) AS persons,
       list(per.c ORDER BY per.person) AS counts
FROM per JOIN s ON per.title = s.title
GROUP BY 1, 2"""


_LINES = """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus) - 1 AS line_no,
       l_orderkey || chr(9) || l_linenumber || chr(9) || l_partkey || chr(9) || l_returnflag || l_linestatus AS value FROM lineitem"""

ORACLE: dict[str, str] = {
    "avg_metric_role_set": _avg(f"WHERE l.l_returnflag || l.l_linestatus IN {_in(ACTING_ROLES)}"),
    "avg_metric_single_role": _avg(f"WHERE l.l_returnflag || l.l_linestatus = '{SINGLE_ROLE}'"),
    "avg_metric_all_roles": _avg("", dedupe=True),
    "avg_metric_role_filter": _avg("WHERE l.l_returnflag || l.l_linestatus IN ('AO', 'RO')"),
    "avg_metric_text_side_file": """
SELECT CAST(l.l_partkey AS VARCHAR) AS nconst,
       CAST(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(o.o_totalprice) / 100 AS avgRating
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l.l_partkey""",
    "cast_list_per_title": _casts(ACTING_ROLES, CHUNK_SIZE),
    "cast_list_per_title_chunked": _casts(None, SMALL_CHUNK),
    "title_pair_stats": f"""
WITH per AS (SELECT title, person, count(*) AS c FROM ({_credits(ACTING_ROLES)}) GROUP BY title, person)
SELECT title, CAST(sum(c) AS BIGINT) AS n_credits, count(*) AS n_persons,
       CAST(CAST(count(*) AS DECIMAL(38,0)) * (count(*) - 1) / 2 + sum(CASE WHEN c >= 2 THEN 1 ELSE 0 END)
            AS DECIMAL(38,0)) AS combo_pairs,
       CAST(CAST(sum(c) AS DECIMAL(38,0)) * (sum(c) - 1) AS DECIMAL(38,0)) AS directed_pairs
FROM per GROUP BY title""",
    "neighbour_slots": f"""
WITH c AS ({_credits()}),
s AS (SELECT title, count(*) AS n FROM c GROUP BY title)
SELECT c.person,
       CAST(CASE WHEN c.person = {BFS_SOURCE} THEN 0 ELSE {UNREACHED} END AS INTEGER) AS distance,
       CAST(sum(CAST(s.n - 1 AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS n_neighbours
FROM c JOIN s ON c.title = s.title
GROUP BY c.person HAVING sum(s.n - 1) > 0""",
    "bfs_distance_full": _bfs_full(GRAPH_ROLES),
    "bfs_distance_full_acting_roles": _bfs_full(ACTING_ROLES),
    "bfs_distance_full_all_roles": _bfs_full(None),
    "bfs_distance_full_indexed": _bfs_full(None),
    "bfs_distance_capped": _bfs_capped_body(GRAPH_ROLES) + "\nSELECT person, distance FROM capped",
    "bfs_distance_capped_all_roles": _bfs_capped_body(None) + "\nSELECT person, distance FROM capped",
    "bfs_level_histogram": f"WITH RECURSIVE {_bfs(GRAPH_ROLES, None)}\n"
                           "SELECT CAST(distance AS INTEGER) AS distance, count(*) AS n_nodes FROM r GROUP BY distance",
    "bfs_distance_gathered": _bfs_capped_body(GRAPH_ROLES)
                             + "\nSELECT person, list_sort(list(distance)) AS distances FROM capped GROUP BY person",
    "word_count": WORD_COUNT_SQL,
    "scan_tsv_schema": PRINCIPALS_SQL,
    "stage_to_parquet": PRINCIPALS_SQL,
    "scan_text_positional": """SELECT CAST(l_orderkey AS VARCHAR) AS tconst, CAST(l_partkey AS VARCHAR) AS nconst,
       l_linenumber AS ordering FROM lineitem""",
    "scan_csv_infer": """SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer""",
    "scan_csv_clean": """SELECT CAST(s_suppkey AS INTEGER) AS row_index, s_name || ', Ltd' AS name,
       'N' || s_nationkey AS nation, s_acctbal AS acctbal, CAST(s_suppkey AS INTEGER) AS id
FROM supplier""",
    "scan_json_nested": """SELECT event_id, user_id, event_type AS type, CAST(NULL AS VARCHAR) AS subtype,
       value AS amount, CAST(user_id AS DOUBLE) AS actor, CAST(NULL AS DOUBLE) AS extra FROM events""",
    "json_nested_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "sink_text_rows": "SELECT '[' || l_orderkey || ',' || count(*) || ']' AS value FROM lineitem GROUP BY l_orderkey",
    "sink_tuple_rows": _bfs_capped_body(GRAPH_ROLES)
                       + "\nSELECT '(' || person || ',' || distance || ')' AS value FROM capped",
    "sink_keyvalue_overwrite": WORD_COUNT_SQL,
    "sink_json_keyvalue": _bfs_capped_body(GRAPH_ROLES)
                          + "\nSELECT person || chr(9) || '[' || distance || ']' AS value FROM capped",
    "subset_first_n": """SELECT l_orderkey AS tconst, l_linenumber AS ordering, l_partkey AS nconst,
       l_returnflag || l_linestatus AS category
FROM lineitem ORDER BY 1, 2, 3, 4 LIMIT 20""",
    "concat_key": """SELECT c_custkey, c_mktsegment, c_nationkey, c_mktsegment || '_cust_' || c_custkey AS id
FROM customer""",
    "rename_add_drop": """SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nation, c_mktsegment AS type,
       'customer' AS origin, CAST(NULL AS VARCHAR) AS closed_on FROM customer""",
    "derived_midpoint": f"""SELECT l_orderkey, l_linenumber, l_partkey, {_midpoint_cols()}
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS low, l_tax AS high FROM lineitem)""",
    "split_get_item": """SELECT c_custkey, split_part(c_name, '#', 1) AS prefix,
       CASE WHEN len(string_split(c_name, '#')) >= 2 THEN string_split(c_name, '#')[2] END AS number,
       CASE WHEN len(string_split(c_name, '#')) >= 3 THEN string_split(c_name, '#')[3] END AS missing
FROM customer""",
    "array_get_item": """SELECT vec_id, embedding[1] AS x0, embedding[2] AS x1, CAST(NULL AS FLOAT) AS past_end
FROM embeddings""",
    "union_by_name": _PARTIES,
    "union_csv_json": _PARTIES,
    "union_by_name_count": f"SELECT origin, count(*) AS n_rows FROM ({_PARTIES}) GROUP BY origin",
    "union_replicate": f"""SELECT s_suppkey, copy, {_midpoint_cols()}
FROM (SELECT s_suppkey, s_acctbal AS low, CAST(s_nationkey AS DOUBLE) AS high,
             CAST(unnest(range(0, {REPLICAS})) AS INTEGER) AS copy FROM supplier)""",
    "union_positional": """SELECT s_suppkey, low, high, (low + high) / 2 AS mid, low AS low_copy, high AS high_copy
FROM (SELECT s_suppkey, s_acctbal AS low, CAST(s_nationkey AS DOUBLE) AS high FROM supplier
      UNION ALL
      SELECT s_suppkey, s_acctbal AS low, CAST(s_nationkey AS DOUBLE) AS high FROM supplier)""",
    "stream_stage_to_parquet": PRINCIPALS_SQL,
    "set_difference": f"""SELECT l_orderkey AS tconst FROM lineitem WHERE l_returnflag || l_linestatus IN {_in(GRAPH_ROLES)}
EXCEPT
SELECT l_orderkey AS tconst FROM lineitem WHERE l_returnflag || l_linestatus = '{SINGLE_ROLE}'""",
    "bitmap_membership": f"""SELECT l_orderkey AS tconst, l_partkey AS nconst, l_linenumber AS ordering FROM lineitem
WHERE l_returnflag || l_linestatus IN {_in(GRAPH_ROLES)} AND l_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag || l_linestatus = '{SINGLE_ROLE}')""",
    "bitmap_distinct_persons": """SELECT l_returnflag || l_linestatus AS category, count(DISTINCT l_partkey) AS n_persons
FROM lineitem GROUP BY 1""",
    "bitmap_common_persons": f"""SELECT l_partkey AS nconst FROM lineitem WHERE l_returnflag || l_linestatus IN {_in(GRAPH_ROLES)}
INTERSECT SELECT l_partkey AS nconst FROM lineitem WHERE l_returnflag || l_linestatus = '{SINGLE_ROLE}'""",
    "line_numbers": _LINES,
    "subset_first_lines": f"SELECT * FROM ({_LINES}) WHERE line_no < 1000",
    "scan_quarantine": """SELECT 'row' AS kind, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem
UNION ALL SELECT 'line', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier""",
    "avg_metric_incremental": _avg(""),
    "adjacency_round_trip": "SELECT DISTINCT l_orderkey AS title, l_partkey AS person FROM lineitem",
    "adjacency_chunk_report": """SELECT l_partkey AS person, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_titles,
       min(l_orderkey) AS first_title, max(l_orderkey) AS last_title, true AS bounded FROM lineitem GROUP BY 1""",
    "neighbours_of_source": f"""SELECT a.l_partkey AS person, b.l_partkey AS neighbour, count(DISTINCT a.l_orderkey) AS n_titles
FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey = {BFS_SOURCE} AND b.l_partkey <> a.l_partkey GROUP BY 1, 2""",
    "scan_json_variant": """SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "json_variant_profile": """SELECT key, kind, count(*) AS n FROM (
  SELECT event_id % 4 AS shape FROM events) JOIN (VALUES
  (0, 'event', 'OBJECT'), (0, 'type', 'STRING'), (0, 'value', 'DECIMAL'), (0, 'props', 'OBJECT'),
  (1, 'event_id', 'BIGINT'), (1, 'user_id', 'BIGINT'), (1, 'type', 'STRING'), (1, 'value', 'STRING'), (1, 'k', 'BIGINT'),
  (3, 'event', 'OBJECT'), (3, 'kind', 'OBJECT'), (3, 'amount', 'DECIMAL'), (3, 'props', 'ARRAY')) v(shape, key, kind) USING (shape)
GROUP BY 1, 2
UNION ALL SELECT 'bad line', 'TEXT', count(*) FROM supplier""",
    "safe_cast_count": f"""SELECT count(*) AS n_tokens, count(x) AS n_numeric, count(*) - count(x) AS n_bad
FROM (SELECT CASE WHEN regexp_full_match(word, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
             THEN TRY_CAST(word AS DOUBLE) END AS x FROM ({_WORDS}))""",
    "partition_skew_report": """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, true AS in_range,
       true AS keys_together FROM lineitem""",
    "sink_text_round_trip": r"""SELECT doc_id, text, ' ' || chr(9) || '\' || text || '\N' || chr(13) || chr(10) || ' ' AS odd,
       '' AS empty, '\N' AS marker FROM documents""",
}
ORACLE["bitmap_set_difference"] = ORACLE["set_difference"]
ORACLE["scan_json_declared"] = ORACLE["scan_json_nested"]
