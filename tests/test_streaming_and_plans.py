"""Incremental staging picks up only new files; plan checks for pushdown and pruning."""

from __future__ import annotations

import os

from castlens.plans.queries import QUERIES
from castlens.streaming import stage_stream
from tests.conftest import SF_SMOKE, write_text

SCHEMA = "tconst string, ordering int, nconst string, category string"


def test_stage_stream_is_incremental(spark, tmp_dir):
    landing, out, ck = (os.path.join(tmp_dir, d) for d in ("landing", "out", "ck"))
    os.makedirs(landing)
    hdr = "tconst\tordering\tnconst\tcategory"
    write_text(os.path.join(landing, "a.tsv"), [hdr, "tt1\t1\tnm1\tactor", "tt1\t2\tnm2\t\\N"])
    first = stage_stream(spark, landing, SCHEMA, out, checkpoint_location=ck)
    assert first.count() == 2
    write_text(os.path.join(landing, "b.tsv"), [hdr, "tt2\t1\tnm3\tactress"])
    second = stage_stream(spark, landing, SCHEMA, out, checkpoint_location=ck)
    rows = sorted((r.tconst, r.nconst, r.category) for r in second.collect())
    assert rows == [("tt1", "nm1", "actor"), ("tt1", "nm2", None), ("tt2", "nm3", "actress")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_role_filter_pushed_and_columns_pruned(spark):
    plan = _plan(QUERIES["avg_metric_role_set"](spark, SF_SMOKE))
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_returnflag:string,l_linestatus:string>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_no_python_or_cartesian_in_any_query(spark):
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF_SMOKE))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython"):
            assert bad not in plan, (name, bad)


def test_replicate_is_one_scan(spark):
    plan = _plan(QUERIES["union_replicate"](spark, SF_SMOKE))
    assert plan.count("FileScan parquet") == 1 and "Generate" in plan
