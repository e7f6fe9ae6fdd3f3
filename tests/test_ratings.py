"""Average rating per person: role handling, bag join, dedupe, exact sums, order."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from castlens.operators.ratings import average_metric_per_person
from castlens.sources.readers import read_principals, read_ratings
from tests.conftest import write_text
from tests.fixtures import dirty_principals_rows, ratings_rows


@pytest.fixture()
def tables(spark, tmp_dir):
    p = read_principals(spark, write_text(os.path.join(tmp_dir, "p.tsv"), dirty_principals_rows()))
    r = read_ratings(spark, write_text(os.path.join(tmp_dir, "r.tsv"), ratings_rows()))
    return p, r


def test_actor_roles_bag_join_fan_out(tables):
    p, r = tables
    got = {x.nconst: x.avgRating for x in average_metric_per_person(p, r).collect()}
    # nm0000001: tt1 6.5, tt2 8.0; nm0000002 credited twice on tt1 (counts twice) → 6.5;
    # nm0000004 acts on tt4 which has two ratings (fan-out) → 6.0; nm0000005: null rating → null;
    # nm0000006's title has no rating → absent
    assert got == {"nm0000001": 7.25, "nm0000002": 6.5, "nm0000004": 6.0, "nm0000005": None}


def test_single_role_and_dedupe_last_wins(spark, tables):
    p, r = tables
    r2 = r.withColumn("line", F.monotonically_increasing_id())
    got = {x.nconst: x.avgRating for x in average_metric_per_person(
        p, r2, roles="producer", dedupe_order_by="line").collect()}
    assert got == {"nm0000003": 6.75}   # tt1 6.5, tt4 last rating 7.0


def test_all_roles_and_null_category(tables):
    p, r = tables
    got = {x.nconst: x.avgRating for x in average_metric_per_person(p, r, roles=None).collect()}
    assert got["nm0000004"] == pytest.approx((8.0 + 5.0 + 7.0) / 3)
    got_actor = {x.nconst for x in average_metric_per_person(p, r).collect()}
    assert "nm0000003" not in got_actor   # producer dropped by the role filter


def test_sort_desc_with_key_tiebreak(tables):
    p, r = tables
    rows = average_metric_per_person(p, r).collect()
    assert [x.nconst for x in rows] == ["nm0000001", "nm0000002", "nm0000004", "nm0000005"]


def test_exact_scale_same_as_avg_on_decimals(spark):
    df = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "a")], "tconst string, nconst string")
    rt = spark.createDataFrame([("t1", 0.1), ("t2", 0.2), ("t3", 0.7)], "tconst string, averageRating double")
    got = average_metric_per_person(df, rt, roles=None, exact_scale=1).collect()[0].avgRating
    assert got == (10 / 3) / 10   # integer tenths summed exactly, then divided


def test_plan_is_builtin_and_has_no_nested_loop(spark, tables):
    p, r = tables
    plan = average_metric_per_person(p, r)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan


def test_exact_scale_skips_nan(spark):
    df = spark.createDataFrame([("t1", "a"), ("t2", "a")], "tconst string, nconst string")
    rt = spark.createDataFrame([("t1", 3.0), ("t2", float("nan"))], "tconst string, averageRating double")
    assert average_metric_per_person(df, rt, roles=None, exact_scale=1).collect()[0].avgRating == 3.0
