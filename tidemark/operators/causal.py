"""Information flow, intervention impact, counterfactuals and permutation causality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changepoint as P
from tidemark.operators import forecast as FC
from tidemark.operators import regress as G
from tidemark.operators import series as S
from tidemark.operators import trend as T


def information_flow(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Simplified Liang-Kleeman flow ``cov(x, y) / var(x) * (cov(x, dx) - cov(y, dy))`` per key.

    Derivatives are central differences; covariances use n - 1 and the variance n.
    """
    d = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), S.gradient(x, keys, order).alias("_dx"), S.gradient(y, keys, order).alias("_dy"))
    flow = F.covar_samp("_x", "_y") / F.var_pop("_x") * (F.covar_samp("_x", "_dx") - F.covar_samp("_y", "_dy"))
    usable = (F.var_pop("_x") > 0) & (F.covar_samp("_x", "_y") != 0)
    return d.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 10, F.when(usable, flow).otherwise(0.0)).alias("flow"))


def impact(df: DataFrame, keys: Sequence[str], t: str, value: str, event: DataFrame) -> DataFrame:
    """Actual minus the continued pre-event line, for rows at and after each key's ``change_index``."""
    rows = df.join(event.select(*keys, "change_index"), list(keys))
    fit = T.ols(rows.where(F.col(t) < F.col("change_index")), keys, t, value).select(*keys, "slope", "intercept")
    after = rows.where(F.col(t) >= F.col("change_index")).join(fit, list(keys))
    after = after.withColumn("expected", F.col("intercept") + F.col("slope") * F.col(t))
    return after.select(*keys, t, F.col(value).alias("actual"), "expected", (F.col(value) - F.col("expected")).alias("impact"))


def counterfactual(df: DataFrame, keys: Sequence[str], t: str, value: str, event: DataFrame, steps: int) -> DataFrame:
    """Three futures: the post-event model, the mean of pre and post models, and no further change."""
    model = P.segmented_fit(df, keys, t, value, event)
    side = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    both = model.groupBy(*keys).agg(*[side(s, c).alias(f"{s}_{c}") for s in ("pre", "post") for c in ("coef", "intercept")])
    last = df.groupBy(*keys).agg(F.max(t).alias("_t"), F.count(F.lit(1)).alias("_n"), F.max("date").alias("_date"), F.max_by(value, t).alias("optimistic"))
    ahead = FC.future_months(last.join(both, list(keys)), "_date", steps)
    ahead = ahead.withColumn(t, F.col("_t") + F.months_between("date", "_date").cast("long")).withColumns(P.season_features(t, F.col("_n")))
    pre = G.linear(P.FEATURES, "pre_coef", "pre_intercept")
    post = G.linear(P.FEATURES, "post_coef", "post_intercept")
    return ahead.select(*keys, "date", post.alias("pessimistic"), ((pre + post) / 2).alias("probable"), "optimistic")


def permutation_causality(df: DataFrame, keys: Sequence[str], t: str, x: str, y: str, lag: int, eps: float, reps: int, seed: int = 0) -> DataFrame:
    """Conditional correlation of lagged ``x`` with ``y`` near the conditioning mean, against shuffled ``x``.

    Permutations are orderings by a hash of replicate and position: one window per
    replicate and key.
    """
    w = S.by(keys, t)
    pairs = df.select(*keys, t, F.col(x).alias("_x"), F.lead(y, lag).over(w).alias("_y"), F.col(y).alias("_c")).na.drop()
    centre = pairs.groupBy(*keys).agg(F.avg("_c").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    pairs = S.with_index(pairs.join(centre, list(keys)).withColumn("_near", F.abs(F.col("_c") - F.col("_mean")) < eps), keys, t, "_i")
    masked = lambda a: F.when(F.count(F.when(F.col("_near"), 1)) >= 10, F.corr(F.when(F.col("_near"), F.col(a)), F.when(F.col("_near"), F.col("_y")))).otherwise(0.0)
    observed = pairs.groupBy(*keys).agg(masked("_x").alias("observed"))
    spread = pairs.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    shuffled = S.with_index(spread.withColumn("_h", F.xxhash64(F.lit(seed), "rep", "_i")), [*keys, "rep"], ["_h", "_i"], "_j")
    moved = shuffled.select(*keys, "rep", F.col("_j").alias("_i"), F.col("_x").alias("_sx"))
    mixed = moved.join(pairs, [*keys, "_i"]).groupBy(*keys, "rep").agg(masked("_sx").alias("_r"))
    p = F.avg(F.when(F.abs(F.col("_r")) >= F.abs(F.col("observed")), 1.0).otherwise(0.0))
    return mixed.join(observed, list(keys)).groupBy(*keys).agg(F.first("observed").alias("observed"), p.alias("p"))


