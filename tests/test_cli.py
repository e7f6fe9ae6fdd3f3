"""The command line on hand-written dumps."""

from __future__ import annotations

import glob
import os

from castlens.__main__ import run
from tests.conftest import write_text
from tests.fixtures import dirty_principals_rows, ratings_rows, write_chain


def _lines(path):
    out = []
    for f in sorted(glob.glob(os.path.join(path, "part-*"))):
        with open(f, encoding="utf-8") as fh:
            out.extend(fh.read().splitlines())
    return out


def test_avg_rating_cli(spark, tmp_dir):
    p = write_text(os.path.join(tmp_dir, "p.tsv"), dirty_principals_rows())
    r = write_text(os.path.join(tmp_dir, "r.tsv"), ratings_rows())
    out = os.path.join(tmp_dir, "avg")
    run(["avg-rating", "--principals", p, "--ratings", r, "--out", out], spark=spark)
    assert _lines(out) == ["[nm0000001,7.25]", "[nm0000002,6.5]", "[nm0000004,6.0]", "[nm0000005,null]"]
    run(["avg-rating", "--principals", p, "--ratings", r, "--roles", "producer", "--last-rating-wins",
         "--out", out], spark=spark)
    assert _lines(out) == ["[nm0000003,6.75]"]     # tt4: the later line (7.0) wins


def test_bfs_cli(spark, tmp_dir):
    chain = write_chain(tmp_dir)
    out = os.path.join(tmp_dir, "bfs")
    run(["bfs", "--principals", chain, "--source", "nm0000102", "--depth", "3", "--keyvalue", "--out", out],
        spark=spark)
    got = dict(line.split("\t") for line in _lines(out))
    assert len(got) == 16 and got["nm0000102"] == "0" and got["nm0000015"] == "10000"
    run(["bfs", "--principals", chain, "--source", "nm0000102", "--roles", "actor,actress", "--out", out],
        spark=spark)
    assert "(nm0000013,5)" in _lines(out) and len(_lines(out)) == 16
    run(["bfs", "--principals", chain, "--depth", "3", "--gathered", "--out", out], spark=spark)
    lines = _lines(out)
    assert '"nm0000102"\t[0]' in lines and '"nm0000015"\t[10000]' in lines and len(lines) == 16


def test_word_count_cli(spark, tmp_dir):
    src = os.path.join(tmp_dir, "txt")
    os.makedirs(src)
    write_text(os.path.join(src, "a.txt"), ["a b  a", "\tb c"])
    out = os.path.join(tmp_dir, "wc")
    run(["word-count", "--input", src, "--out", out], spark=spark)
    assert sorted(_lines(out)) == ["a\t2", "b\t2", "c\t1"]


def test_avg_rating_exact_scale(spark, tmp_dir):
    p = write_text(os.path.join(tmp_dir, "p.tsv"), dirty_principals_rows())
    r = write_text(os.path.join(tmp_dir, "r.tsv"), ratings_rows())
    out = os.path.join(tmp_dir, "avg")
    run(["avg-rating", "--principals", p, "--ratings", r, "--all-roles", "--exact-scale", "1", "--out", out],
        spark=spark)
    assert "[nm0000004,6.666666666666667]" in _lines(out)     # (8.0 + 5.0 + 7.0) / 3 from exact tenths
    run(["avg-rating", "--principals", p, "--ratings", r, "--all-roles", "--exact-scale", "1", "--keyvalue", "--out", out],
        spark=spark)
    assert "nm0000004\t6.666666666666667" in _lines(out)


def test_stage_cli(spark, tmp_dir):
    p = write_text(os.path.join(tmp_dir, "p.tsv"), dirty_principals_rows())
    out = os.path.join(tmp_dir, "staged")
    run(["stage", "--input", p, "--table", "principals", "--num-files", "2", "--out", out], spark=spark)
    staged = spark.read.parquet(out)
    assert staged.count() == 10 and staged.columns[:3] == ["tconst", "ordering", "nconst"]   # header row dropped
    assert len(glob.glob(os.path.join(out, "part-*.parquet"))) == 2
