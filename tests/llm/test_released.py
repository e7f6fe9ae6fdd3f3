"""Finished steps leave no shuffle files behind."""

from __future__ import annotations

import time

from castlens.llm.frames import cut, release


def shuffle_files(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {x for x in blocks.mkString(" ").split() if x.startswith("shuffle_")}


def test_shuffle_files_of_the_step_that_just_ended_go(spark):
    before = shuffle_files(spark)
    got = cut(spark.range(5000).repartition(7, "id"), "ended")
    mine = shuffle_files(spark) - before
    assert mine
    time.sleep(1)                     # the events of the step are through
    release(spark)
    end = time.time() + 20
    while mine & shuffle_files(spark) and time.time() < end:
        time.sleep(0.2)
    assert not mine & shuffle_files(spark)
    assert got.count() == 5000
