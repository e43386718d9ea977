"""Order-dependent operators for series of any length.

A window over ``partitionBy(series)`` runs one series in one task, so a series
with a third of all rows would stall the job.  These operators split each series
into blocks, work inside the blocks, and carry a small per-block summary across
them.  All are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _before(keys: Sequence[str], block: str):
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "t") -> DataFrame:
    """Zero-based position in each series.

    ``bucket`` is a coarse column that never decreases along ``order`` (an hour, a
    day).  Buckets are counted with map-side combine, their counts are summed
    along the series, and rows are numbered only within their bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(_before(keys, "_bucket")), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return rows.join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_off") + inside - 1).drop("_bucket", "_off")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, name: str) -> DataFrame:
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_s"))
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_s").over(_before(keys, "_bucket")), F.lit(0))).drop("_s")
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_off") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_bucket", "_off")


def frame_blocks(df: DataFrame, idx: str, before: int, after: int, block: int) -> DataFrame:
    """Give each row to its own block and to the neighbours whose row frames reach it.

    ``_own`` marks the row's own block.  With ``block`` far above the frame length
    the copies are a vanishing share of the rows.
    """
    lo = F.floor(F.greatest(F.col(idx) - after, F.lit(0)) / block)
    hi = F.floor((F.col(idx) + before) / block)
    spread = df.withColumn("_block", F.explode(F.sequence(lo, hi)))
    return spread.withColumn("_own", F.col("_block") == F.floor(F.col(idx) / block))


def windowed(df: DataFrame, keys: Sequence[str], idx: str, before: int, after: int, exprs: dict, block: int = 100_000) -> DataFrame:
    """Row-frame window expressions over indexed rows.

    ``exprs`` maps a column name to a function of the ordered window; it may look
    back ``before`` rows and ahead ``after`` rows.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(idx)
    spread = frame_blocks(df, idx, before, after, block)
    return spread.withColumns({n: f(w) for n, f in exprs.items()}).where("_own").drop("_block", "_own")


def interpolate_linear(df: DataFrame, keys: Sequence[str], idx: str, value: str, block: int = 100_000) -> DataFrame:
    """Linear interpolation by position with flat ends, for indexed rows of long series."""
    rows = df.withColumn("_block", F.floor(F.col(idx) / block))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    edges = rows.groupBy(*keys, "_block").agg(F.max(known).alias("_last"), F.min(known).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_block")
    edges = edges.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    )
    w = Window.partitionBy(*keys, "_block").orderBy(idx)
    a = F.coalesce(F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carry"))
    b = F.coalesce(F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_next"))
    out = rows.join(edges, [*keys, "_block"]).withColumns({"_a": a, "_b": b})
    step = (F.col("_b.v") - F.col("_a.v")) * (F.col(idx) - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    filled = F.coalesce(F.col(value), F.col("_a.v") + step, F.col("_a.v"), F.col("_b.v"))
    return out.withColumn(value, filled).drop("_block", "_carry", "_next", "_a", "_b")


def value_splits(df: DataFrame, value: str, parts: int) -> list[float]:
    """At most ``parts - 1`` approximate quantiles of a column, as block boundaries."""
    probs = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(value, probs, 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def split_block(value: str, splits: Sequence[float]) -> Column:
    """Block of a value: even blocks are open intervals, odd blocks hold one boundary value each.

    A frequent value is a boundary, so it never weighs on the block of its neighbours.
    """
    if not splits:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(s)) for s in splits])
    below = F.size(F.filter(bounds, lambda s: s < F.col(value)))
    return 2 * below + F.when(F.array_contains(bounds, F.col(value)), 1).otherwise(0)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, parts: int, **extra: Column) -> DataFrame:
    """Distinct values per key with their counts and value block: ``keys, value, _c, _block`` and ``extra`` aggregates.

    Counted with map-side combine and checkpointed, because every caller reads it
    more than once and the facts should be read once.
    """
    clean = df.where(F.col(value).isNotNull())
    counts = cut_lineage(clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), *[c.alias(n) for n, c in extra.items()]))
    return counts.withColumn("_block", split_block(value, value_splits(counts, value, parts)))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], parts: int = 64) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size: ``keys, prob, quantile``.

    Counts per value block locate the blocks that hold the wanted ranks; only the
    distinct values of those blocks are ordered.
    """
    counts = value_counts(df, keys, value, parts)
    blocks = counts.groupBy(*keys, "_block").agg(F.sum("_c").alias("_bc"))
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    blocks = blocks.withColumns({"_end": F.sum("_bc").over(along), "_total": F.sum("_bc").over(whole)})
    hits = (
        blocks.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_bc")))
    )
    asked = F.collect_set(F.struct("prob", "_pos", "_rank"))  # at most two entries per probability
    hits = hits.groupBy(*keys, "_block").agg(F.first(F.col("_end") - F.col("_bc")).alias("_start"), asked.alias("_asked"))
    inside = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(hits, [*keys, "_block"]).withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
    mine = lambda q: (q["_rank"] < F.col("_upto")) & (q["_rank"] >= F.col("_upto") - F.col("_c"))
    found = ranked.select(*keys, value, F.inline(F.filter("_asked", mine)))
    lo, hi = F.min(value), F.max(value)
    share = F.first("_pos") - F.floor(F.first("_pos"))
    return found.groupBy(*keys, "prob").agg((lo + (hi - lo) * share).alias("quantile"))
