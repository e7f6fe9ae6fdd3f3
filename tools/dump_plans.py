"""Write PLANS.md: the physical plans (explain "formatted") of the headline
queries at a given scale, to review pushdown, pruning, join strategy and
exchanges. usage: python tools/dump_plans.py [sf_dir]"""

from __future__ import annotations

import contextlib
import io
import sys

sys.path.insert(0, ".")
from castlens.plans.queries import QUERIES  # noqa: E402
from castlens.session import build_session  # noqa: E402

NOTES = {
    "avg_metric_role_set": "role filter in PushedFilters; 4 of 11 lineitem columns read; ratings broadcast if "
                           "AQE measures them small; partial → final average per person; range-partitioned sort.",
    "avg_metric_all_roles": "one rating per title via a partial + final (sort-based) max, then the join.",
    "title_pair_stats": "two partial + final aggregations: (title, person) then title — a huge title ships "
                        "one partial row per task.",
    "neighbour_slots": "credits counted per (title, person) first (copies collapse map-side); title sizes "
                       "joined back (broadcast by size here; shuffled with AQE skew split at scale); partial + "
                       "final exact sum per person.",
    "cast_list_per_title": "credits counted per (title, person) first (copies collapse map-side); one chunk formula "
                           "for every title; one collect of (person, count) per (title, chunk).",
    "word_count": "tokens exploded and counted partial → final.",
    "bfs_distance_capped": "the result is a union of per-level checkpoints left-joined to the node set; the "
                           "level jobs are shown at the end.",
    "union_replicate": "one scan and a Generate, no union tree and no join.",
}
NAMES = list(NOTES)


def _trim(plan: str) -> str:
    keep = []
    for line in plan.splitlines():
        # the cached copies print their own build plan; keep only its first line
        if line.startswith(" " * 40):
            continue
        keep.append(line)
    return "\n".join(keep)


def bfs_level_plans(spark, sf_dir):
    """Physical plan of a job of the search, two hops long."""
    from castlens.operators import graph as G
    from castlens.plans.queries import _credits
    from castlens.plans.tables import BFS_SOURCE, GRAPH_ROLES

    captured, reach = [], G._reach

    def spy(*args):
        out = reach(*args)
        captured.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    G._reach = spy
    G.bfs_distances(G.bipartite_edges(_credits(spark, sf_dir, GRAPH_ROLES)), BFS_SOURCE, max_depth=2, hops=2)
    G._reach = reach
    return ["## A job of the search (two hops)", "",
            "The persons and titles found are made distinct per task and shuffled; the bucketed tables (`Bucketed: true`) are neither",
            "shuffled nor sorted, and what the union reads again is a reused exchange.", "",
            "```", _trim(captured[-1]), "```", ""]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/dump_plans.py` at `{sf_dir}` (AQE on; the adaptive plan may change joins at run time).", ""]
    for name in NAMES:
        df = QUERIES[name](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        # keep the tree and the scan details; drop per-node boilerplate
        keep = []
        for line in text.splitlines():
            if line.startswith(("Output", "Arguments", "Input", "Results", "Aggregate Attributes",
                                "Functions", "Keys", "Left keys", "Right keys", "Batched", "Location")):
                continue
            keep.append(line)
        out += [f"## {name}", "", NOTES[name], "", "```", "\n".join(keep).strip(), "```", ""]
    out += bfs_level_plans(spark, sf_dir)
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
