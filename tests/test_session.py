"""What a checkpoint leaves on disk."""

import time

from pyspark.sql import functions as F

from tidemark.session import CLEANUP_CONF, cut_lineage


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


def test_a_checkpoint_keeps_no_shuffle(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP_CONF, None)
    counted = spark.range(10_000).groupBy((F.col("id") % 77).alias("k")).count()
    kept = cut_lineage(counted)
    for _ in range(50):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP_CONF, None) == setting
    # the frame itself may still be used, also together with what became of it
    assert counted.join(kept, "k").count() == kept.count() == len(counted.collect()) == 77


def test_a_loop_of_checkpoints_and_joins_keeps_its_estimate_short(spark):
    """The estimate of a join is the product of its sides; carried on, its digits double each round."""
    rows = cut_lineage(spark.range(50).selectExpr("id % 7 AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("v")))
    want = {r.k: r.v for r in rows.collect()}
    for _ in range(8):
        rows = cut_lineage(rows.join(rows.select("k", F.col("v").alias("w")), "k").select("k", F.greatest("v", "w").alias("v")))
        assert rows._jdf.logicalPlan().stats().sizeInBytes() < 1 << 63
    assert {r.k: r.v for r in rows.collect()} == want
    assert rows.join(rows.withColumnRenamed("v", "w"), "k").where("v = w").count() == 7
