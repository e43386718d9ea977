"""Bootstrap resampling as joins: draws are rows, statistics are grouped aggregates.

For statistics that are functions of sums, :mod:`replicate` needs neither draws as rows nor a join.
Draws come from a hash of replicate and position, so a task rerun after an
executor loss draws the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import inference as I
from tidemark.operators import series as S
from tidemark.operators import trend as T

Draw = Callable[[Column, Column, Column], Column]


def hash_draw(seed: int) -> Draw:
    """Pseudo-random position below ``n`` for replicate ``rep`` and place ``i``."""
    return lambda rep, i, n: F.pmod(F.xxhash64(F.lit(seed), rep, i), n)


def draws(lengths: DataFrame, reps: int, draw: Draw, n: str = "n", places: Column | None = None) -> DataFrame:
    """``reps`` samples per row of ``lengths``, with replacement: adds ``rep, place, pick``; a task holds some replicates of a key."""
    count = places if places is not None else F.col(n)
    d = lengths.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    d = d.repartition(*lengths.columns, "rep")
    d = d.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
    return d.withColumn("pick", draw(F.col("rep"), F.col("place"), F.col(n)).cast("long"))


def resampled(df: DataFrame, keys: Sequence[str], idx: str, reps: int, draw: Draw) -> DataFrame:
    """Rows of each key drawn with replacement, ``reps`` times: the columns of ``df`` plus ``rep``.

    A draw joins on key and position, so even one long series spreads over all tasks.
    """
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    picks = draws(lengths, reps, draw).select(*keys, "rep", F.col("pick").alias(idx))
    return picks.join(df, [*keys, idx])


def interval(df: DataFrame, keys: Sequence[str], value: str, level: float = 95.0) -> DataFrame:
    """Mean, population sd and percentile interval over replicates (as many rows per key as replicates)."""
    tail = (100 - level) / 200
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, tail).alias("ci_lower"), F.percentile(value, 1 - tail).alias("ci_upper")
    )


def sen_interval(df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, reps: int, draw: Draw) -> DataFrame:
    """Bootstrap distribution of the Theil-Sen slope; replicates with a single ``x`` drop out."""
    slopes = T.theil_sen(resampled(df, keys, idx, reps, draw), [*keys, "rep"], x, y, batch="rep")
    return interval(slopes.where(F.col("slope").isNotNull()), keys, "slope")


def residual_band(forecast: DataFrame, residuals: DataFrame, keys: Sequence[str], step: str, idx: str, residual: str, reps: int, draw: Draw) -> DataFrame:
    """Band of a forecast plus resampled residuals.

    ``residuals`` carry a position ``idx`` per key; each forecast step draws ``reps`` of them.
    """
    n = residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    d = forecast.join(n, list(keys)).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    d = d.withColumn(idx, draw(F.col("rep"), F.col(step), F.col("n")).cast("long")).join(residuals.select(*keys, idx, F.col(residual).alias("_r")), [*keys, idx])
    d = d.withColumn("_v", F.col("forecast") + F.col("_r"))
    return d.groupBy(*keys, step).agg(F.first("forecast").alias("forecast"), F.percentile("_v", 0.025).alias("ci_lower"), F.percentile("_v", 0.975).alias("ci_upper"))


# ------------------------------------------------------------------ moving blocks


def block_length(df: DataFrame, keys: Sequence[str], order: str, value: str, max_lag: int = 20) -> DataFrame:
    """Block length per series from its lagged correlations: ``keys, n, block``, between 2 and 10.

    ``b = (2 n sum (k rho_k)^2 / sum rho_k^2)^(1/3)`` over lags up to ``min(20, n // 3)``.
    """
    lagged = I.lagged_correlation(df, keys, order, value, value, range(1, max_lag + 1))
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    use = lagged.join(n, list(keys)).where(F.col("lag") <= F.least(F.lit(max_lag), F.floor(F.col("_n") / 3)))
    rho = F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))
    sums = use.groupBy(*keys).agg(F.sum(F.pow(F.col("lag") * rho, 2)).alias("_top"), F.sum(rho * rho).alias("_bottom"))
    g = n.join(sums, list(keys), "left")
    raw = F.bround(F.pow(2 * F.col("_top") / (F.col("_bottom") + 1e-10) * F.col("_n"), F.lit(1 / 3)))
    size = F.when(F.col("_n") < 10, 2).when(F.coalesce("_bottom", F.lit(0.0)) == 0, 3).otherwise(F.greatest(F.least(raw, F.lit(10)), F.lit(2)))
    return g.select(*keys, F.col("_n").alias("n"), size.cast("long").alias("block"))


def block_welch(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, order: str, value: str, reps: int, draw: Draw) -> DataFrame:
    """Moving-block bootstrap of Welch's t between two groups: mean t, interval, two-sided p.

    Both groups use the longer of their two block lengths; a replicate strings
    blocks together and keeps as many rows as the group has.
    """
    rows = S.with_index(df.where(F.col(group).isin(a, b)).select(*keys, group, order, value), [*keys, group], order, "_i")
    sizes = block_length(rows, [*keys, group], "_i", value)
    longest = sizes.groupBy(*keys).agg(F.max("block").alias("_b"))
    plan = sizes.drop("block").join(longest, list(keys)).withColumn("_b", F.least("_b", "n"))
    plan = plan.withColumn("_starts", F.col("n") - F.col("_b") + 1)
    blocks = draws(plan, reps, draw, n="_starts", places=F.ceil(F.col("n") / F.col("_b")))
    picks = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    picks = picks.where(F.col("place") * F.col("_b") + F.col("_o") < F.col("n")).select(*keys, group, "rep", (F.col("pick") + F.col("_o")).cast("long").alias("_i"))
    sample = picks.join(rows, [*keys, group, "_i"])
    m = I.side_by_side(I.group_moments(sample, [*keys, "rep"], group, value), [*keys, "rep"], group, a, b)
    pa, pb = a.lower(), b.lower()
    t = F.try_divide(F.col(f"{pa}_mean") - F.col(f"{pb}_mean"), F.sqrt(F.col(f"{pa}_var") / F.col(f"{pa}_n") + F.col(f"{pb}_var") / F.col(f"{pb}_n")))
    t_rows = m.withColumn("t_stat", t).where(F.col("t_stat").isNotNull())
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return t_rows.groupBy(*keys).agg(
        F.avg("t_stat").alias("t_stat"),
        (2 * F.least(share(F.col("t_stat") <= 0), share(F.col("t_stat") >= 0))).alias("p"),
        F.percentile("t_stat", 0.025).alias("ci_lower"),
        F.percentile("t_stat", 0.975).alias("ci_upper"),
    )


