"""What cutting lineage leaves on disk."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from rowloom.llm import common


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in found.mkString("\n").split("\n") if "/shuffle_" in name}


def test_shuffle_files_go_with_the_cut(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    sums = spark.range(10_000, numPartitions=3).groupBy((F.col("id") % 7).alias("key")).agg(F.sum("id").alias("total"))
    frame = sums.join(spark.range(7).hint("merge"), F.col("key") == F.col("id"))
    kept = common.cut(frame)  # ``frame`` stays referred to, so that no garbage collector may delete its files
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common.CLEANUP, None) == setting
    assert [kept.count() for _ in range(2)] == [7, 7] and frame.count() == 7
    assert {r["key"]: r["total"] for r in kept.collect()} == {k: sum(range(k, 10_000, 7)) for k in range(7)}
