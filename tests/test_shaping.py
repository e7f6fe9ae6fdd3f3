"""Reshaping operators and scalar helpers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from castlens.functions import concat_key, safe_double, split_get
from castlens.operators.partitions import partition_report, partition_summary, repartition
from castlens.operators.shaping import (first_n, rename_add_drop, replicate, set_difference,
                                        union_by_name, with_key, with_midpoint)


def test_rename_add_drop_single_projection(spark):
    df = spark.createDataFrame([(1, "A", 2)], "row_no int, TITLE string, batch int")
    out = rename_add_drop(df, {"TITLE": "title"}, {"origin": "batch file"}, ["row_no", "batch"],
                          null_columns={"closed_on": "string"})
    assert out.columns == ["title", "origin", "closed_on"]
    assert dict(out.dtypes)["closed_on"] == "string"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def test_concat_key_null_propagates(spark):
    df = spark.createDataFrame([("x", "red", "1"), ("x", None, "2")], "shelf string, colour string, id string")
    got = [r.k for r in with_key(df, "k", "shelf", F.lit("_"), "colour", F.lit("_"), "id").collect()]
    assert got == ["x_red_1", None]
    assert df.select(concat_key("shelf", "id", sep="-").alias("k")).first().k == "x-1"


def test_split_get_absent_is_null(spark):
    df = spark.createDataFrame([("a - open",), ("closed",)], "t string")
    assert [r.x for r in df.select(split_get("t", " - ", 1).alias("x")).collect()] == ["open", None]


def test_safe_double(spark):
    texts = {"6.5": 6.5, " -2e3 ": -2000.0, ".5": 0.5, "7.": 7.0, "abc": None, "": None, "1d": None, "1f": None, "1_0": None,
             "NaN": None, "Infinity": None, "0x10": None, ".": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", safe_double("t").alias("x")).collect()} == texts


def test_midpoint_is_double_for_ints(spark):
    df = spark.createDataFrame([(1, 2)], "low int, high int")
    out = with_midpoint(df, "low", "high", "mid", copies={"low_copy": "low", "high_copy": "high"})
    r = out.first()
    assert r.mid == 1.5 and r.low_copy == 1 and dict(out.dtypes)["mid"] == "double"


def test_union_by_name_mixed_codes(spark):
    a = spark.createDataFrame([(40, "x")], "code int, name string")
    b = spark.createDataFrame([("y", "40-b")], "name string, code string")
    out = union_by_name([a, b], to_string=["code"])
    assert sorted(r.code for r in out.collect()) == ["40", "40-b"]
    with pytest.raises(Exception):
        union_by_name([a, spark.createDataFrame([("z",)], "name string")]).collect()
    filled = union_by_name([a, spark.createDataFrame([("z",)], "name string")], allow_missing=True)
    assert filled.count() == 2


def test_replicate_constant_plan(spark):
    df = spark.range(5)
    out = replicate(df, 61)
    assert out.count() == 305
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_set_difference_set_and_bag(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(3,)], "k int")
    assert sorted(r.k for r in set_difference(a, b).collect()) == [1, 2]
    assert sorted(r.k for r in set_difference(a, b, on=["k"], distinct=False).collect()) == [1, 1, 2]
    n = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    assert [r.k for r in set_difference(n, b).where("k is null").collect()] == [None]
    assert [r.k for r in set_difference(n, n).collect()] == []


def test_set_difference_shuffles_distinct_rows(spark):
    """A title with a third of the rows on both sides is one row per task in each exchange."""
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("t"))
    right = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") + 1500).alias("t"))
    out = set_difference(hot, right)
    assert {r.t for r in out.collect()} == {i for i in range(1500) if i % 3}
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in lines[i + 1], lines[i + 1]


def test_first_n_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a int, b int")
    got = [(r.a, r.b) for r in first_n(df, 5, ["a", "b"]).collect()]
    assert got == sorted((i % 7, i) for i in range(50))[:5]


def test_partition_reports(spark):
    df = repartition(spark.range(1000).withColumnRenamed("id", "k"), 4, ["k"])
    rows = partition_report(df).collect()
    assert sum(r.n_rows for r in rows) == 1000 and len(rows) <= 4
    keys = spark.range(1000).selectExpr("id % 10 as k")
    assert tuple(partition_summary(keys, 4, ["k"]).first()) == (1000, 10, True, True)
    assert tuple(partition_summary(keys.where("k > 99"), 4, ["k"]).first()) == (0, 0, True, True)


def test_added_then_dropped_columns_are_pruned(spark):
    """Derived columns added and then dropped never reach the physical plan
    (Catalyst collapses the projections), even over a replicated input."""
    df = spark.createDataFrame([(1.0, 2.0)], "low double, high double")
    full = with_midpoint(replicate(df, 61), "low", "high", "mid", copies={"low_copy": "low", "high_copy": "high"}) \
        .drop("mid", "low_copy", "high_copy")
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "mid" not in plan and "low_copy" not in plan
    assert full.count() == 61


def test_cluster_conf_sizes_partitions():
    from castlens.session import cluster_conf
    big = cluster_conf(100 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))     # by bytes, no cap
    mid = cluster_conf(10 * 10**12, 2000)
    assert int(mid["spark.sql.shuffle.partitions"]) == -(-10 * 10**12 // (256 << 20))
    small = cluster_conf(10**9, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 192      # three waves of tasks
    assert small["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
