"""Forecasts and what-if analysis built from fitted lines, seasons and harmonics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import regress as G
from tidemark.operators import series as S
from tidemark.operators import trend as T


def future_months(keys: DataFrame, last: str, steps: int) -> DataFrame:
    """Continue each key's calendar for ``steps`` months after its date column ``last``."""
    nxt = F.explode(F.sequence(F.add_months(last, 1), F.add_months(last, steps), F.expr("interval 1 month")))
    return keys.withColumn("date", nxt).withColumns({"year": F.year("date").cast("long"), "month": F.month("date").cast("long")})


def scaled_seasonal(df: DataFrame, keys: Sequence[str], value: str, since: int, first_year: int, last_year: int) -> DataFrame:
    """Annual straight line over recent years times the last year's monthly pattern.

    An incomplete last year gives a flat pattern; series with fewer than 12 recent
    rows or 3 recent years are left out.
    """
    recent = df.where(F.col("year") >= since)
    annual = recent.groupBy(*keys, "year").agg(F.avg(value).alias("_v"))
    fit = T.ols(annual, keys, "year", "_v").where(F.col("n") >= 3)
    enough = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max("year").alias("_last")).where(F.col("_rows") >= 12)
    fit = fit.join(enough, list(keys)).select(*keys, "slope", "intercept", "_last")
    pattern = recent.join(fit.select(*keys, "_last"), list(keys)).where(F.col("year") == F.col("_last")).groupBy(*keys, "month").agg(F.avg(value).alias("_m"))
    level = pattern.groupBy(*keys).agg(F.avg("_m").alias("_mean"), F.count(F.lit(1)).alias("_months"))
    grid = S.calendar_grid(fit.join(level, list(keys)), first_year, last_year).join(pattern, [*keys, "month"], "left")
    line = F.col("intercept") + F.col("slope") * F.col("year")
    seasonal = (F.col("_months") == 12) & (F.col("_mean") != 0)
    return grid.select(*keys, "year", "month", F.when(seasonal, line * F.col("_m") / F.col("_mean")).otherwise(line).alias("forecast"))


def scaled_seasonal_ahead(df: DataFrame, keys: Sequence[str], value: str, recent_years: int = 5, years: int = 5) -> DataFrame:
    """:func:`scaled_seasonal` from each series' own last year: its ``recent_years`` last years give the next ``years``."""
    last = df.groupBy(*keys).agg(F.max("year").alias("_end"))
    rows = df.join(last, list(keys)).withColumn("year", F.col("year") - F.col("_end")).drop("_end")
    ahead = scaled_seasonal(rows, keys, value, 1 - recent_years, 1, years)
    return ahead.join(last, list(keys)).withColumn("year", (F.col("year") + F.col("_end")).cast("long")).drop("_end")


def endpoint_trend(df: DataFrame, keys: Sequence[str], order: str, value: str, since: Column, steps: int) -> DataFrame:
    """Extend the last value by the mean step between the first and last recent value: ``keys, step, forecast``."""
    g = df.groupBy(*keys).agg(
        F.max_by(value, order).alias("_last"),
        F.min_by(value, F.when(since, F.col(order))).alias("_first"),
        F.max_by(value, F.when(since, F.col(order))).alias("_end"),
        F.count(F.when(since, 1)).alias("_n"),
    )
    slope = F.try_divide(F.col("_end") - F.col("_first"), F.col("_n") - 1)
    g = g.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    return g.select(*keys, "step", (F.col("_last") + slope * F.col("step")).alias("forecast"))


def shrink_to_mean(df: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], steps: int, keep: float = 0.99) -> DataFrame:
    """Future features that move from the last row towards the mean, ``x <- keep x + (1 - keep) mean`` per step.

    Step 1 is the last row itself; the recursion has the closed form used here.
    """
    g = df.groupBy(*keys).agg(*[F.max_by(c, order).alias(f"_last_{c}") for c in features], *[F.avg(c).alias(f"_mean_{c}") for c in features])
    g = g.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))
    decay = F.pow(F.lit(keep), F.col("step") - 1)
    return g.select(*keys, "step", *[(F.col(f"_mean_{c}") + decay * (F.col(f"_last_{c}") - F.col(f"_mean_{c}"))).alias(c) for c in features])


def mean_features(df: DataFrame, keys: Sequence[str], features: Sequence[str], steps: int) -> DataFrame:
    """Future features held at their training mean."""
    g = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in features])
    return g.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))))


def calibrate_splice(proxy: DataFrame, observed: DataFrame, keys: Sequence[str], switch: int, fit_until: int, min_overlap: int = 5) -> DataFrame:
    """Fit the observed level to a proxy where both exist, use the fit before ``switch`` and observations after.

    Both inputs are ``keys, year, x``; the result is ``keys, year, value, source``.
    """
    observed = observed.where(F.col("year") >= switch).select(*keys, "year", F.col("x").alias("_obs"))
    overlap = proxy.join(observed, [*keys, "year"]).where(F.col("year") <= fit_until)
    fit = T.ols(overlap, keys, "x", "_obs").where(F.col("n") >= min_overlap).select(*keys, "slope", "intercept")
    early = proxy.where(F.col("year") < switch).join(fit, list(keys))
    early = early.select(*keys, "year", (F.col("intercept") + F.col("slope") * F.col("x")).alias("value"), F.lit("proxy").alias("source"))
    late = observed.join(fit, list(keys), "left_semi").select(*keys, "year", F.col("_obs").alias("value"), F.lit("observed").alias("source"))
    return early.unionByName(late)


# ------------------------------------------------------------------ what-if


def scenario_rows(df: DataFrame, features: Sequence[str], scenarios: Mapping[str, Mapping[str, tuple[str, float]]], name: str = "scenario") -> DataFrame:
    """Each row once per scenario, with its features scaled (``"*"``) or shifted (``"+"``) in physical units."""
    spread = df.withColumn(name, F.explode(F.array(*[F.lit(s) for s in scenarios])))
    changed = {}
    for f in features:
        expr = F.col(f)
        for s, changes in scenarios.items():
            if f in changes:
                op, arg = changes[f]
                expr = F.when(F.col(name) == s, F.col(f) * arg if op == "*" else F.col(f) + arg).otherwise(expr)
        changed[f] = expr
    return spread.withColumns(changed)


def scenario_summary(predicted: DataFrame, keys: Sequence[str], prediction: str, baseline: str, name: str = "scenario") -> DataFrame:
    """Mean, population sd and percent change against the baseline scenario."""
    g = predicted.groupBy(*keys, name).agg(F.avg(prediction).alias("mean_level"), F.stddev_pop(prediction).alias("std_level"))
    base = F.max(F.when(F.col(name) == baseline, F.col("mean_level"))).over(Window.partitionBy(*keys))
    return g.withColumn("change_pct", 100 * F.try_divide(F.col("mean_level") - base, base))


def sensitivity(df: DataFrame, model: DataFrame, keys: Sequence[str], features: Sequence[str], y: str, percents: Sequence[int] = (-20, -10, 10, 20)) -> DataFrame:
    """Mean absolute change of a linear prediction when one feature moves by a percentage, in target sds.

    The change is ``coef * x * pct``, so one aggregate per feature serves every percentage.
    """
    g = df.groupBy(*keys).agg(F.stddev_pop(y).alias("_sd"), *[F.avg(F.abs(F.col(f))).alias(f"_a{i}") for i, f in enumerate(features)])
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("name"), F.lit(p).cast("long").alias("change_pct"), (F.abs(F.col("coef")[i]) * F.col(f"_a{i}") * abs(p) / 100.0 / F.col("_sd")).alias("sensitivity"))
            for i, f in enumerate(features)
            for p in percents
        ]
    )
    return g.join(model.select(*keys, "coef"), list(keys)).select(*keys, F.inline(rows))


# ------------------------------------------------------------------ harmonics

# The periods, in months, of the harmonic model.
HARMONIC_PERIODS = (52.3, 8.7, 5.2, 3.7, 3.3)


def harmonic_columns(t: str | Column, periods: Sequence[float] = HARMONIC_PERIODS) -> dict[str, Column]:
    t = F.col(t) if isinstance(t, str) else t
    out = {}
    for i, p in enumerate(periods):
        out[f"_c{i}"], out[f"_s{i}"] = F.cos(t * (2 * math.pi / p)), F.sin(t * (2 * math.pi / p))
    return out


def harmonic_fit(df: DataFrame, keys: Sequence[str], t: str, residual: str, periods: Sequence[float] = HARMONIC_PERIODS) -> DataFrame:
    """Least-squares cosine and sine terms at fixed periods, no intercept: a linear model per key."""
    cols = harmonic_columns(t, periods)
    return G.fit(df.withColumns(cols), keys, list(cols), residual, origin=True)


def harmonic_table(model: DataFrame, keys: Sequence[str], periods: Sequence[float] = HARMONIC_PERIODS) -> DataFrame:
    """Amplitude and phase per period; a term is ``amplitude * cos(2 pi t / period + phase)``."""
    rows = []
    for i, p in enumerate(periods):
        a, b = F.col("coef")[2 * i], F.col("coef")[2 * i + 1]
        rows.append(F.struct(F.lit(float(p)).alias("period"), F.sqrt(a * a + b * b).alias("amplitude"), F.atan2(-b, a).alias("phase")))
    return model.select(*keys, F.inline(F.array(*rows)))


def harmonic_forecast(df: DataFrame, keys: Sequence[str], t: str, value: str, steps: int, periods: Sequence[float] = HARMONIC_PERIODS) -> DataFrame:
    """Trend plus monthly season plus harmonics, ``steps`` months ahead: ``keys, date, year, month, t, forecast``."""
    parts = S.deseasonalised(df, keys, t, value)
    model = harmonic_fit(parts, keys, t, "residual", periods)
    line = T.ols(df, keys, t, value).select(*keys, "slope", F.col("intercept").alias("_a"))
    season = parts.groupBy(*keys, "month").agg(F.first("seasonal").alias("_season"))
    last = df.groupBy(*keys).agg(F.max(t).alias("_t"), F.max("date").alias("_date"))
    ahead = future_months(last.join(line, list(keys)).join(model.select(*keys, "coef", "intercept"), list(keys)), "_date", steps)
    ahead = ahead.withColumn(t, F.col("_t") + F.months_between("date", "_date").cast("long"))
    ahead = ahead.withColumns(harmonic_columns(t, periods)).join(season, [*keys, "month"], "left")
    waves = G.linear(list(harmonic_columns(t, periods)))
    forecast = F.col("_a") + F.col("slope") * F.col(t) + F.coalesce("_season", F.lit(0.0)) + waves
    return ahead.select(*keys, "date", "year", "month", t, forecast.alias("forecast"))


def annual_rollup(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "year").agg(*[F.avg(c).alias(c) for c in cols])
