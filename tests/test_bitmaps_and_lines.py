"""Bitmap set algebra and lines by their place, against plain Python."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from castlens.operators import (bitmap_difference, bitmap_intersection, bitmap_keys, bitmap_members, distinct_counts, key_bitmaps)
from castlens.sources import number_lines, read_quarantined
from tests.conftest import write_text

EDGES = [0, 1, -1, 2, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 65537, 2**40, -2**40, 2**63 - 1, -2**63 + 1]


def _ints(spark, values, name="k"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long").repartition(4)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_keys_survive_bitmaps(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        pick = random.Random(3)
        values = EDGES + [pick.randint(-10**6, 10**6) for _ in range(500)] * 2 + [None, None]
        got = [r.k for r in bitmap_keys(key_bitmaps(_ints(spark, values), "k"), "k").collect()]
        assert sorted(got) == sorted(set(values) - {None})
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_set_operations(spark):
    pick = random.Random(5)
    a = EDGES[:10] + [pick.randint(-200_000, 200_000) for _ in range(3000)] + list(range(70_000, 72_000)) + [None]
    b = EDGES[5:] + [pick.randint(-200_000, 200_000) for _ in range(3000)] + list(range(71_000, 75_000)) + [None]
    left, right = _ints(spark, a), _ints(spark, b)
    a, b = set(a) - {None}, set(b) - {None}
    assert sorted(r.k for r in bitmap_difference(left, right, "k").collect()) == sorted(a - b)
    assert sorted(r.k for r in bitmap_intersection(left, right, "k").collect()) == sorted(a & b)
    none = left.where("k IS NULL")
    assert bitmap_difference(none, right, "k").count() == bitmap_intersection(left, none, "k").count() == 0
    assert sorted(r.k for r in bitmap_difference(left, none, "k").collect()) == sorted(a)


def test_members_and_counts(spark):
    pick = random.Random(7)
    rows = [(pick.choice("xyz"), pick.choice([None, *EDGES, *range(40)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, i int").repartition(3)
    some = set(EDGES[::2]) | set(range(0, 40, 3))
    got = bitmap_members(df, _ints(spark, [*some, *some]), "k", spread_by=["i"])
    assert got.columns == df.columns
    assert sorted(r.i for r in got.collect()) == [i for _, k, i in rows if k in some]
    counts = {r.g: r.n for r in distinct_counts(df, "k", ["g"]).collect()}
    assert counts == {g: len({k for h, k, _ in rows if h == g and k is not None}) for g in "xyz"}


def test_bitmaps_move_instead_of_rows(spark):
    """A hundred thousand rows of a hundred keys: a bitmap per task leaves the scan."""
    df = spark.range(0, 100_000, 1, 4).select((F.col("id") % 100).alias("k"))
    plan = bitmap_difference(df, df.where("k < 50"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
    assert "hashpartitioning(k" not in plan


def _files(tmp_dir, sizes):
    want, n = [], 0
    for i, size in enumerate(sizes):
        lines = [f"file {i} line {j} " + "x" * (j % 90) for j in range(size)]
        write_text(os.path.join(tmp_dir, f"part-{i:03d}.txt"), lines, final_newline=i % 2 == 0)
        want += [(i, j + 1, n + j, line) for j, line in enumerate(lines)]
        n += size
    return want


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_line_numbers(spark, tmp_dir, split):
    """Many files, several to a task or several blocks to a file; an empty one among them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        want = _files(tmp_dir, [5, 200, 1, 90, 333])
        write_text(os.path.join(tmp_dir, "part-0015.txt"), [], final_newline=False)
        df = number_lines(spark, tmp_dir)
        got = [(int(r.file[-7:-4]), r.line, r.line_no, r.value) for r in df.collect()]
        assert sorted(got, key=lambda r: r[2]) == want
        for n in (0, 1, 5, 6, 206, 10_000):
            assert sorted(r.line_no for r in number_lines(spark, tmp_dir, first=n).collect()) == list(range(min(n, 629)))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "RangePartitioning" not in plan and "rangepartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quarantine(spark, tmp_dir):
    schema = StructType.fromDDL("id bigint, n int, name string, x double")
    write_text(os.path.join(tmp_dir, "a.tsv"), ["id\tn\tname\tx", "1\t2\tone\t1.5", "2\t\\N\t\"two\t\\N", "x\t2\tbad id\t1", "", "3\t4\ttoo few"])
    write_text(os.path.join(tmp_dir, "b.tsv"), ["4\t1\tmany\t1\t2", "5\t1.5\tno int\t1", "6\t7\tfine\t-2e3", "id\tn\tname\tx", "7\t1\tok\tabc"])
    good, bad = read_quarantined(spark, tmp_dir, schema)
    assert sorted(map(tuple, good.collect())) == [(1, 2, "one", 1.5), (2, None, '"two', None), (6, 7, "fine", -2000.0)]
    assert sorted((r.file[-5:], r.line, r.value) for r in bad.collect()) == [
        ("a.tsv", 4, "x\t2\tbad id\t1"), ("a.tsv", 6, "3\t4\ttoo few"),
        ("b.tsv", 1, "4\t1\tmany\t1\t2"), ("b.tsv", 2, "5\t1.5\tno int\t1"), ("b.tsv", 5, "7\t1\tok\tabc")]
    assert good.schema == schema
