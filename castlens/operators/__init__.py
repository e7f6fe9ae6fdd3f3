from castlens.operators.adjacency import compressed_rows, decoded, members_between, neighbours
from castlens.operators.bitmaps import (bitmap_difference, bitmap_intersection, bitmap_keys,
                                       bitmap_members, distinct_counts, key_bitmaps)
from castlens.operators.graph import (UNREACHED, bfs_distances, bfs_distances_capped,
                                     bipartite_edges, cast_lists, credits, gather_distances,
                                     graph_nodes, level_histogram, neighbour_slots,
                                     title_pair_stats, title_sizes)
from castlens.operators.incremental import (add_batch, compact_states, merge_states, metric_states,
                                            read_states, state_averages, vacuum_states)
from castlens.operators.joins import materialize
from castlens.operators.partitions import partition_report, partition_summary, repartition
from castlens.operators.ratings import (average_metric_per_person, latest_per_key, matched_metrics,
                                        role_filter)
from castlens.operators.shaping import (first_n, rename_add_drop, replicate, set_difference,
                                        union_all, union_by_name, with_key, with_midpoint,
                                        with_sql_columns)
from castlens.operators.skew import hot_keys, skew_join
from castlens.operators.text import word_count
from castlens.operators.variants import (read_variant_lines, variant_columns, variant_field, variant_profile,
                                         variant_schema)

__all__ = [
    "UNREACHED", "bfs_distances", "bfs_distances_capped", "bipartite_edges", "cast_lists", "credits",
    "gather_distances", "graph_nodes", "level_histogram", "neighbour_slots", "title_pair_stats",
    "title_sizes", "materialize", "partition_report", "partition_summary", "repartition",
    "with_sql_columns",
    "average_metric_per_person", "latest_per_key", "role_filter", "first_n", "rename_add_drop",
    "replicate", "set_difference", "union_all", "union_by_name", "with_key", "with_midpoint",
    "word_count", "hot_keys", "skew_join", "bitmap_difference", "bitmap_intersection", "bitmap_keys",
    "bitmap_members", "distinct_counts", "key_bitmaps", "compressed_rows", "decoded", "members_between", "neighbours",
    "add_batch", "compact_states", "merge_states", "metric_states", "read_states", "state_averages", "vacuum_states",
    "matched_metrics", "read_variant_lines", "variant_columns", "variant_field", "variant_profile", "variant_schema",
]
