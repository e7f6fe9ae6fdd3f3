"""Command line: run the credit jobs on raw dumps.

    python -m castlens avg-rating --principals P.tsv --ratings R.tsv --roles actor,actress --out DIR
    python -m castlens avg-rating --principals P.tsv --ratings R.tsv --all-roles --last-rating-wins --out DIR
    python -m castlens bfs --principals P.tsv --source nm0000102 [--depth 6] [--roles actor,actress] --out DIR
    python -m castlens word-count --input TEXT_DIR --out DIR
    python -m castlens stage --input RAW.tsv.gz --table principals|ratings [--num-files N] --out DIR

Paths may be any Hadoop-FS URI. Output is written with overwrite, one text
line per row: ``[nconst,avgRating]`` sorted by average for ratings,
``(nconst,distance)`` for the search (or ``nconst<TAB>distance`` with
``--keyvalue``, or ``"nconst"<TAB>[distance]`` with ``--gathered``),
``word<TAB>count`` for word count.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from castlens.constants import ACTING_ROLES, DEFAULT_SOURCE, HEADER_KEY
from castlens.operators import graph as G
from castlens.operators.ratings import average_metric_per_person
from castlens.operators.text import word_count
from castlens.session import checkpoint_dir
from castlens.sources.readers import (PRINCIPALS_SCHEMA, RATINGS_SCHEMA, read_principals, read_ratings,
                                      with_line_order)
from castlens.sources.sinks import stage_to_parquet, write_keyvalue, write_text_rows


def _roles(args):
    if getattr(args, "all_roles", False) or not args.roles:
        return None
    return [r.strip() for r in args.roles.split(",") if r.strip()]


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="castlens")
    sub = p.add_subparsers(dest="cmd", required=True)

    a = sub.add_parser("avg-rating", help="average title rating per person")
    a.add_argument("--principals", required=True)
    a.add_argument("--ratings", required=True)
    a.add_argument("--roles", default=",".join(ACTING_ROLES))
    a.add_argument("--all-roles", action="store_true")
    a.add_argument("--last-rating-wins", action="store_true",
                   help="one rating per title: the one on the last line of the ratings file(s)")
    a.add_argument("--exact-scale", type=int, default=None,
                   help="ratings have at most this many decimals: sum them exactly (e.g. 1 for x.y ratings)")
    a.add_argument("--keyvalue", action="store_true", help="key<TAB>value lines, the line-oriented job's layout")
    a.add_argument("--out", required=True)

    b = sub.add_parser("bfs", help="degrees of separation from one person")
    b.add_argument("--principals", required=True)
    b.add_argument("--source", default=DEFAULT_SOURCE)
    b.add_argument("--depth", type=int, default=None, help="depth limit; unreached persons get 10000")
    b.add_argument("--roles", default=None, help="comma-separated roles (default: all)")
    b.add_argument("--keyvalue", action="store_true")
    b.add_argument("--gathered", action="store_true",
                   help='JSON key-value lines with the distances gathered in a list: "nm…"<TAB>[d]')
    b.add_argument("--out", required=True)

    g = sub.add_parser("stage", help="raw credit or ratings dump → typed Parquet")
    g.add_argument("--input", required=True)
    g.add_argument("--table", choices=["principals", "ratings"], required=True)
    g.add_argument("--num-files", type=int, default=None,
                   help="spread the rows over this many files (for unsplittable .gz dumps)")
    g.add_argument("--out", required=True)

    w = sub.add_parser("word-count", help="token counts of text files")
    w.add_argument("--input", required=True)
    w.add_argument("--out", required=True)

    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"castlens-{args.cmd}").getOrCreate()
    checkpoint_dir(spark)

    if args.cmd == "avg-rating":
        ratings = read_ratings(spark, args.ratings)
        if args.last_rating_wins:
            ratings = with_line_order(ratings)
        res = average_metric_per_person(
            read_principals(spark, args.principals), ratings, roles=_roles(args),
            dedupe_order_by="line_order" if args.last_rating_wins else None,
            exact_scale=args.exact_scale, sort=False)
        if args.keyvalue:
            write_keyvalue(res, args.out, "nconst", "avgRating")
        else:
            write_text_rows(res, args.out, ["nconst", "avgRating"], style="list",
                            sort_by=[F.col("avgRating").desc_nulls_last(), F.col("nconst")])
    elif args.cmd == "bfs":
        cr = G.credits(read_principals(spark, args.principals), roles=_roles(args))
        if args.depth is None:
            res = G.bfs_distances(G.bipartite_edges(cr), args.source)
        else:
            res = G.bfs_distances_capped(cr, args.source, max_depth=args.depth)
        if args.gathered:
            write_keyvalue(G.gather_distances(res), args.out, "person", "distances", json=True)
        elif args.keyvalue:
            write_keyvalue(res, args.out, "person", "distance")
        else:
            write_text_rows(res, args.out, ["person", "distance"], style="tuple")
    elif args.cmd == "stage":
        schema = PRINCIPALS_SCHEMA if args.table == "principals" else RATINGS_SCHEMA
        stage_to_parquet(spark, args.input, schema, args.out, num_files=args.num_files, header_key=HEADER_KEY)
    elif args.cmd == "word-count":
        res = word_count(spark.read.text(args.input), "value")
        write_keyvalue(res, args.out, "word", "count")


def main() -> None:
    run(sys.argv[1:])


if __name__ == "__main__":
    main()
