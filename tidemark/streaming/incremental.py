"""Idempotent incremental batches: compute what is missing, keep what is there.

The workloads served here are bounded files that arrive over time, so progress is
a keyed result table and a resumed run is an anti-join against it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from tidemark.operators import relational as R
from tidemark.sources import sinks


def run_pending(tasks: DataFrame, store: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], schema, partition_by: Sequence[str] = ()) -> DataFrame:
    """Compute the tasks that have no stored result, append them, and return the whole store.

    Running it again computes nothing; a run that was cut off leaves nothing half
    written, because a Spark job commits its files together.
    """
    spark = tasks.sparkSession
    todo = R.pending(tasks, sinks.read_store(spark, store, schema), keys)
    sinks.append_results(compute(todo), store, partition_by)
    return sinks.read_store(spark, store, schema)


def merge_results(new: DataFrame, store: str, keys: Sequence[str], schema) -> DataFrame:
    """The store with new results replacing those of the same key."""
    return R.upsert(sinks.read_store(new.sparkSession, store, schema), new, keys)
