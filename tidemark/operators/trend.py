"""Trend estimation: straight lines, rank trends, change of level by ranks, forecast bands.

Rank statistics rest on ``sign_before``, the per-row count of earlier smaller
minus earlier larger values.  It is found by merging sorted halves, so no pair
of rows is ever produced.  ``sign_before_long`` does the same across blocks for
series of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import columns as C
from tidemark.functions import kernels
from tidemark.functions.special import t_p_value, t_ppf
from tidemark.operators import blocked as B
from tidemark.operators import concordance as K
from tidemark.operators import series as S
from tidemark.session import cut_lineage

# ------------------------------------------------------------------ straight lines


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Straight-line fit per key from sums alone: slope, intercept, R2 and what intervals need."""
    x_, y_ = F.col(x).cast("double"), F.col(y)
    return df.groupBy(*keys).agg(
        F.regr_slope(y_, x_).alias("slope"),
        F.regr_intercept(y_, x_).alias("intercept"),
        F.regr_r2(y_, x_).alias("r2"),
        F.regr_count(y_, x_).alias("n"),
        F.regr_avgx(y_, x_).alias("x_mean"),
        F.regr_sxx(y_, x_).alias("sxx"),
        F.regr_syy(y_, x_).alias("syy"),
        F.max(x).alias("x_last"),
    )


def residual_ss() -> Column:
    """Residual sum of squares from the columns of :func:`ols`."""
    rss = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    return F.when(rss < 0, 0.0).otherwise(rss)


def ols_tested(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """:func:`ols` with the t statistic of the slope and its two-sided p value."""
    fit = ols(df, keys, x, y)
    se = F.sqrt(F.try_divide(residual_ss(), (F.col("n") - 2) * F.col("sxx")))
    fit = fit.withColumn("t_stat", F.try_divide(F.col("slope"), se))
    return fit.withColumn("p", t_p_value("t_stat", (F.col("n") - 2).cast("double")))


def future(fit: DataFrame, horizon: int, x: str) -> DataFrame:
    return fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(x, (F.col("x_last") + F.col("h")).cast("long"))


def forecast_constant_band(df: DataFrame, keys: Sequence[str], x: str, y: str, horizon: int, z: float = 1.96) -> DataFrame:
    """Straight-line forecast with a band of ``z`` population sds of the residuals.

    The residual variance follows from the same sums as the fit, so the data is read once.
    """
    fit = ols(df, keys, x, y).withColumn("sd", F.sqrt(residual_ss() / F.col("n")))
    out = future(fit, horizon, x).withColumn("forecast", F.col("intercept") + F.col("slope") * F.col(x))
    return out.select(
        *keys, x, "forecast", (F.col("forecast") - z * F.col("sd")).alias("lower"), (F.col("forecast") + z * F.col("sd")).alias("upper")
    )


def forecast_t_interval(df: DataFrame, keys: Sequence[str], x: str, y: str, horizon: int, level: float = 0.95) -> DataFrame:
    """Prediction interval ``t * sqrt(MSE (1 + 1/n + (x - mean)^2 / Sxx))`` with ``MSE = RSS / n``."""
    fit = ols(df, keys, x, y).withColumn("t_crit", t_ppf(F.lit((1 + level) / 2), (F.col("n") - 2).cast("double")))
    mse = residual_ss() / F.col("n")
    out = future(fit, horizon, x).withColumn("forecast", F.col("intercept") + F.col("slope") * F.col(x))
    half = F.col("t_crit") * F.sqrt(mse * (1 + 1 / F.col("n") + F.pow(F.col(x) - F.col("x_mean"), 2) / F.col("sxx")))
    return out.select(*keys, x, "forecast", (F.col("forecast") - half).alias("lower"), (F.col("forecast") + half).alias("upper"))


def weighted_ols(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: Column) -> DataFrame:
    """Weighted straight line; ``r2`` is the unweighted score of the weighted fit."""
    d = df.withColumns({"_w": weight.cast("double"), "_x": F.col(x).cast("double"), "_y": F.col(y)}).na.drop(subset=["_w", "_x", "_y"])
    centre = d.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_mx"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_my")
    )
    c = d.join(centre, list(keys)).withColumns({"_dx": F.col("_x") - F.col("_mx"), "_dy": F.col("_y") - F.col("_my")})
    g = c.groupBy(*keys).agg(
        F.first("_mx").alias("_mx"),
        F.first("_my").alias("_my"),
        F.sum(F.col("_w") * F.col("_dx") * F.col("_dx")).alias("_sxx"),
        F.sum(F.col("_w") * F.col("_dx") * F.col("_dy")).alias("_sxy"),
        F.count(F.lit(1)).alias("n"),
        F.sum("_dx").alias("_d1"),
        F.sum("_dy").alias("_e1"),
        F.sum(F.col("_dx") * F.col("_dx")).alias("_d2"),
        F.sum(F.col("_dy") * F.col("_dy")).alias("_e2"),
        F.sum(F.col("_dx") * F.col("_dy")).alias("_de"),
    )
    slope = F.try_divide(F.col("_sxy"), F.col("_sxx"))
    sse = F.col("_e2") - 2 * F.col("slope") * F.col("_de") + F.col("slope") * F.col("slope") * F.col("_d2")
    sst = F.col("_e2") - F.col("_e1") * F.col("_e1") / F.col("n")
    g = g.withColumn("slope", slope)
    return g.select(*keys, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), (1 - sse / sst).alias("r2"), "n")


def slope_windows(df: DataFrame, keys: Sequence[str], x: str, y: str, starts: Sequence[int], end: int) -> DataFrame:
    """Slope and R2 over several windows that share an end; each row counts once per window it lies in."""
    windows = F.array(*[F.lit(int(s)).cast("long") for s in starts])
    spread = df.where(F.col(x) <= end).withColumn("start", F.explode(F.filter(windows, lambda s: s <= F.col(x))))
    return ols(spread, [*keys, "start"], x, y).select(*keys, "start", "slope", "r2", "n")


# ------------------------------------------------------------------ ranks without pairs


def _per_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn, out: dict) -> DataFrame:
    """Append numpy-computed columns to each ordered, calendar-bounded group."""
    schema = StructType([*df.schema.fields, *[StructField(n, t) for n, t in out.items()]])
    order = list(order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**fn(pdf))

    return df.groupBy(*keys).applyInPandas(run, schema)


def sign_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "sign_before") -> DataFrame:
    """Earlier smaller minus earlier larger values, per row of a calendar series."""
    return _per_series(df, keys, order, lambda p: {name: kernels.sign_before(p[value].to_numpy())}, {name: LongType()})


def sign_before_long(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, name: str = "sign_before", block: int = 100_000, parts: int = 64
) -> DataFrame:
    """The same for indexed series of any length.

    Rows fall into a grid of time blocks by value blocks.  Pairs in different
    time and value blocks are counted from the cell counts; pairs that share a
    time block, or a value block, are counted inside that block.  A frequent
    value has a block of its own in which every pair is a tie, and that block is
    never gathered.
    """
    splits = B.value_splits(df, value, parts)
    rows = df.withColumns({"_tb": F.floor(F.col(idx) / block).cast("long"), "_vb": B.split_block(value, splits).cast("long")})
    cells = rows.groupBy(*keys, "_tb", "_vb").agg(F.count(F.lit(1)).alias("_c"))
    dense = cells.select(*keys, "_tb").distinct().withColumn("_vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * len(splits)).cast("long"))))
    dense = dense.join(cells, [*keys, "_tb", "_vb"], "left").na.fill(0, ["_c"])
    earlier = Window.partitionBy(*keys, "_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.withColumn("_e", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    lower = Window.partitionBy(*keys, "_tb").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(*keys, "_tb").orderBy("_vb").rowsBetween(1, Window.unboundedFollowing)
    dense = dense.withColumn("_cross", F.coalesce(F.sum("_e").over(lower), F.lit(0)) - F.coalesce(F.sum("_e").over(higher), F.lit(0)))
    dense = dense.select(*keys, "_tb", "_vb", "_cross")

    # blocks of one value hold nothing but ties: cut them by time so that no group gathers a frequent value
    rows = rows.withColumn("_cut", F.when(F.col("_vb") % 2 == 1, F.col("_tb")).otherwise(F.lit(-1).cast("long")))
    in_time = sign_before(rows, [*keys, "_tb"], [idx], "_vb", "_in_time")
    in_value = sign_before(in_time, [*keys, "_vb", "_cut"], [idx], value, "_in_value")
    both = in_value.join(dense, [*keys, "_tb", "_vb"])
    return both.withColumn(name, F.col("_cross") + F.col("_in_time") + F.col("_in_value")).drop("_cross", "_in_time", "_in_value", "_tb", "_vb", "_cut")


def mann_kendall_statistics(counts: DataFrame, sums: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall statistics from rows ``_t`` per value and sign sums ``_s`` per key: S, tie-corrected variance, tau, z, p, label."""
    t = F.col("_t").cast("double")
    g = counts.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum(t * (t - 1) * (2 * t + 5)).alias("_ties"))
    g = sums.withColumnRenamed("_s", "s").join(g, list(keys))
    n = F.col("n").cast("double")
    g = g.withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18.0)
    sign = F.signum(F.col("s").cast("double"))
    z = F.when(F.col("var_s") > 0, (F.col("s") - sign) / F.sqrt("var_s"))
    g = g.withColumns({"tau": F.try_divide(F.col("s").cast("double"), n * (n - 1) / 2), "z": z}).withColumn("p", C.normal_two_sided_p("z"))
    label = F.when((F.col("p") < alpha) & (F.col("z") > 0), "increasing").when((F.col("p") < alpha) & (F.col("z") < 0), "decreasing").otherwise("no trend")
    return g.withColumn("trend", label).drop("_ties")


def mann_kendall_from_signs(signed: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall statistics from ``sign_before`` rows."""
    per_value = signed.groupBy(*keys, value).agg(F.sum("sign_before").alias("_s"), F.count(F.lit(1)).alias("_t"))
    return mann_kendall_statistics(per_value, per_value.groupBy(*keys).agg(F.sum("_s").alias("_s")), keys, alpha)


def mann_kendall(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float = 0.05) -> DataFrame:
    clean = df.select(*keys, order, value).where(F.col(value).isNotNull())
    return mann_kendall_from_signs(sign_before(clean, keys, [order], value), keys, value, alpha)


def mann_kendall_long(df: DataFrame, keys: Sequence[str], idx: str, value: str, alpha: float = 0.05, block: int = K.BLOCK) -> DataFrame:
    """:func:`mann_kendall` for series of any length, from the concordance of position (whole numbers from 0, each once) and value."""
    clean = cut_lineage(df.select(*keys, idx, value).where(F.col(value).isNotNull()))
    sums = K.concordance(clean, keys, idx, value, block=block, positions=True).select(*keys, F.col("s").cast("long").alias("_s"))
    return mann_kendall_statistics(clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t")), sums, keys, alpha)


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "slope", batch: str | None = None, batch_size: int = 64) -> DataFrame:
    """Median pairwise slope over a calendar series, pairs of equal ``x`` left out.

    ``batch`` names an integer key (a replicate number) of which ``batch_size``
    neighbours share a task call: many small series cost few calls.
    """
    clean = df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fields = [f for f in clean.schema.fields if f.name in keys]
    names = [f.name for f in fields]
    schema = StructType([*fields, StructField(name, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, at in pdf.groupby(names, sort=False).indices.items():
            found = kernels.theil_sen(pdf[x].to_numpy(float)[at], pdf[y].to_numpy(float)[at])
            out.append((*(key if isinstance(key, tuple) else (key,)), None if np.isnan(found) else found))
        return pd.DataFrame(out, columns=[*names, name])

    if batch is None:
        return clean.groupBy(*keys).applyInPandas(run, schema)
    shared = [F.col(k) for k in keys if k != batch] + [F.floor(F.col(batch) / batch_size)]
    return clean.groupBy(*shared).applyInPandas(run, schema)


def pettitt(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Pettitt test: ``change_index`` is the last position before the shift, with K and clamped p.

    U_t equals ``t (n + 1) - 2 * (sum of the first t ranks)``, so ranks and one running sum suffice.
    """
    rows = S.with_index(df.where(F.col(value).isNotNull()), keys, order, "_t")
    rows = rows.withColumn("_rank", S.average_rank(value, keys))
    w = Window.partitionBy(*keys)
    upto = S.by(keys, "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_u": (F.col("_t") + 1) * (F.count(F.lit(1)).over(w) + 1) - 2 * F.sum("_rank").over(upto)})
    return _pettitt_summary(rows, keys, clamp=True)


def pettitt_sequential(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The running variant: U accumulates each value's sign sum against its past; p is left unclamped."""
    rows = sign_before(df.where(F.col(value).isNotNull()).select(*keys, order, value), keys, [order], value)
    rows = S.with_index(rows, keys, order, "_t")
    upto = S.by(keys, "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "_u": F.sum("sign_before").over(upto).cast("double")})
    return _pettitt_summary(rows, keys, clamp=False)


def _pettitt_summary(rows: DataFrame, keys: Sequence[str], clamp: bool) -> DataFrame:
    best = F.min(F.struct((-F.abs(F.col("_u"))).alias("k"), F.col("_t").alias("t")))
    g = rows.groupBy(*keys).agg(best.alias("_b"), F.max("_n").alias("n"))
    g = g.select(*keys, F.col("_b.t").alias("change_index"), (-F.col("_b.k")).alias("k"), "n")
    n = F.col("n").cast("double")
    p = 2 * F.exp(-6 * F.col("k") * F.col("k") / (n * n * n + n * n))
    return g.withColumn("p", F.least(p, F.lit(1.0)) if clamp else p)


def kendall_tau_b(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b: sign sums of ``y`` in ``x`` order, corrected for ties in either."""
    clean = df.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    signed = sign_before(clean, keys, [x, y], y)

    def tied_pairs(cols: Sequence[str], name: str) -> DataFrame:
        c = F.count(F.lit(1)).cast("double")
        per = clean.groupBy(*keys, *cols).agg((c * (c - 1) / 2).alias("_p"))
        return per.groupBy(*keys).agg(F.sum("_p").alias(name))

    g = signed.groupBy(*keys).agg(F.sum("sign_before").cast("double").alias("_s"), F.count(F.lit(1)).cast("double").alias("_n"))
    for cols, name in (([x], "_tx"), ([y], "_ty"), ([x, y], "_txy")):
        g = g.join(tied_pairs(cols, name), list(keys))
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    s = F.col("_s") - (F.col("_tx") - F.col("_txy"))  # within an x tie the y order added one per distinct pair
    return g.select(*keys, F.try_divide(s, F.sqrt((pairs - F.col("_tx")) * (pairs - F.col("_ty")))).alias("tau_b"))
