"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTING = threading.Lock()


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; extra settings win.

    Cluster sizing (memory, shuffle partitions, split size) is left to the
    submitter: AQE coalesces or splits shuffle partitions from measured sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")  # one process: local-cluster has executors of its own


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own, or a scratch one in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not _is_local(spark):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so lost executors cost no recomputation.

    The shuffles that led to it go at once: nothing reads them again, and else they stay until the driver happens to
    collect its garbage. Other actions keep the session's setting.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _SETTING:
        before = spark.conf.get(CLEANUP_CONF, None)
        spark.conf.set(CLEANUP_CONF, "true")
        try:
            own = df.select("*")  # takes the setting with it
        finally:
            spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    return _bounded(own.checkpoint(eager=True))


def _bounded(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` whose estimated size is a long at most.

    A checkpoint takes its plan's estimate with it, and a join's is the product of its sides: in a loop of checkpoints and
    joins its digits multiply each round, to millions, which every plan node holds on the driver. Above a long it is
    left unknown, which plans alike; rows, partitioning and order stay.
    """
    plan = df._jdf.logicalPlan()
    try:
        known = plan.stats().sizeInBytes() < 1 << 63
    except ValueError:  # more digits than Python reads
        known = False
    if known:
        return df
    sql, option, session = df.sparkSession._jvm.org.apache.spark.sql, df.sparkSession._jvm.scala.Option, df.sparkSession._jsparkSession
    kept = plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream()
    unknown = sql.execution.LogicalRDD(*kept, session, option.empty(), option.apply(plan.constraints()))
    return DataFrame(sql.classic.Dataset.ofRows(session, unknown), df.sparkSession)
