"""Average states by batch: replays, merged bases, lost attempts; equal to the full recomputation."""

from __future__ import annotations

import os
import random

import pytest

from castlens.operators.incremental import (add_batch, compact_states, metric_states, read_states,
                                            state_averages, vacuum_states)
from castlens.operators.ratings import average_metric_per_person


@pytest.fixture()
def data(spark):
    rng = random.Random(2)
    credits = [(rng.randrange(40), 0 if rng.random() < 0.3 else rng.randrange(1, 30), rng.choice(["actor", "producer"]), rng.randrange(4))
               for _ in range(900)]
    rated = [(t, None if t == 3 else float("nan") if t == 4 else round(rng.uniform(0, 10), 1), d) for t in range(35) for d in range(t % 3 + 1)]
    return (spark.createDataFrame([*credits, (3, 77, "actor", 1), (None, 5, "actor", 2), (8, None, "actor", 0)],
                                  "tconst long, nconst long, category string, batch int"),
            spark.createDataFrame(rated, "tconst long, averageRating double, rated_at int"))


@pytest.mark.parametrize("match", [{}, {"roles": ["actor"]}, {"dedupe_order_by": "rated_at", "hot_rows": 20}])
def test_batches_equal_the_recomputation(spark, data, tmp_dir, match):
    credits, rated = data
    path = f"{tmp_dir}/states"

    def land(b):
        return add_batch(metric_states(credits.where(f"batch = {b}"), rated, exact_scale=1, **match), b, path)

    def rows():
        return state_averages(read_states(spark, path), exact_scale=1).collect()

    def full(upto):
        return average_metric_per_person(credits.where(f"batch <= {upto}"), rated, exact_scale=1, **{"roles": None, **match}).collect()
    assert rows() == [] and compact_states(spark, path) == -1
    assert land(0) and rows() == full(0)
    assert land(1) and land(1) and rows() == full(1)                 # replayed: counts once
    assert compact_states(spark, path) == 1 and rows() == full(1)
    assert not land(0) and not land(1) and rows() == full(1)         # already in the base
    assert land(2) and rows() == full(2)
    assert vacuum_states(spark, path) == 2 and rows() == full(2)
    assert land(3) and compact_states(spark, path) == 3 and compact_states(spark, path) == 3
    assert vacuum_states(spark, path) == 3 and vacuum_states(spark, path) == 0 and rows() == full(3)


def test_a_half_written_batch_does_not_count(spark, data, tmp_dir):
    credits, rated = data
    path = f"{tmp_dir}/states"
    states = metric_states(credits, rated, exact_scale=1)
    add_batch(states, 0, path)
    want = state_averages(read_states(spark, path), exact_scale=1).collect()
    states.write.parquet(f"{path}/delta/batch=1")
    os.remove(f"{path}/delta/batch=1/_SUCCESS")                      # as a job leaves it that dies before its commit
    assert state_averages(read_states(spark, path), exact_scale=1).collect() == want
    with pytest.raises(ValueError):
        add_batch(states, -1, path)


def test_a_batch_without_matches(spark, data, tmp_dir):
    credits, rated = data
    add_batch(metric_states(credits.where("false"), rated, exact_scale=1), 5, tmp_dir + "/s")
    assert state_averages(read_states(spark, tmp_dir + "/s"), exact_scale=1).collect() == []
