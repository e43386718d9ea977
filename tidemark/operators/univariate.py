"""Whole-series estimators on calendar series: one grouped Arrow pass each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from tidemark.functions import forecasters as N
from tidemark.operators import forecast as FC
from tidemark.operators import regress as G
from tidemark.operators.regress import square
from tidemark.operators.spectral import _keyed, _schema


def quantile_slopes(df: DataFrame, keys: Sequence[str], x: str, y: str, taus: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantile regression lines: ``keys, tau, slope, intercept``."""
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop()
    grid = [float(t) for t in taus]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [N.quantile_line(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), t) for t in grid]
        return _keyed(pdf, keys, {"tau": grid, "slope": [b for b, _ in lines], "intercept": [a for _, a in lines]})

    d = DoubleType()
    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, tau=d, slope=d, intercept=d))


def unit_root(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant: ``keys, stat, p, lags``."""
    rows = df.select(*keys, order, value).na.drop()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stat, p, k = N.augmented_dickey_fuller(pdf.sort_values(order)[value].to_numpy(float))
        return _keyed(pdf, keys, {"stat": [stat], "p": [p], "lags": [k]})

    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, stat=DoubleType(), p=DoubleType(), lags=LongType()))


def arima(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    steps: int,
    pdq: tuple[int, int, int] = (1, 1, 1),
    seasonal: tuple[int, int, int] = (0, 0, 0),
    period: int = 12,
    exog: Sequence[str] = (),
) -> DataFrame:
    """(Seasonal) ARIMA forecasts: ``keys, step, forecast, sigma``; future regressors hold their training mean."""
    rows = df.select(*keys, order, value, *exog).na.drop()
    names = list(exog)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[names].to_numpy(float) if names else None
        ahead = np.tile(x.mean(axis=0), (steps, 1)) if names else None
        out, _, var = N.arima_forecast(pdf[value].to_numpy(float), steps, pdq, seasonal, period, x, ahead)
        return _keyed(pdf, keys, {"step": np.arange(1, steps + 1), "forecast": out, "sigma": np.sqrt(var)})

    d = DoubleType()
    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, step=LongType(), forecast=d, sigma=d))


def gaussian_process(df: DataFrame, keys: Sequence[str], order: str, xs: Sequence[str], y: str, train: Column) -> DataFrame:
    """Fit on training rows, predict every row: ``keys, order, actual, prediction, sd, is_train``."""
    rows = df.select(*keys, order, *xs, y, train.alias("_train")).na.drop()
    names = list(xs)
    order_type = rows.schema[order].dataType

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = pdf["_train"].to_numpy(bool)
        x = pdf[names].to_numpy(float)
        x = (x - x[fit].mean(axis=0)) / np.where(x[fit].std(axis=0) > 0, x[fit].std(axis=0), 1.0)
        mean, sd = N.gaussian_process(x[fit], pdf[y].to_numpy(float)[fit], x)
        return _keyed(pdf, keys, {order: pdf[order].to_numpy(), "actual": pdf[y].to_numpy(float), "prediction": mean, "sd": sd, "is_train": fit})

    schema = _schema(rows, keys, **{order: order_type}, actual=DoubleType(), prediction=DoubleType(), sd=DoubleType())
    return rows.groupBy(*keys).applyInPandas(run, schema.add(StructField("is_train", rows.schema["_train"].dataType)))


def ard(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Automatic relevance determination from moments: ``keys, name, coefficient``."""
    m = G.moments(df, keys, [*xs, y])
    p = len(xs)

    def solve(n: pd.Series, covs: pd.Series) -> pd.Series:
        def one(count, c):
            cov = square(np.asarray(c, float), p + 1)
            scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
            unit = cov / np.outer(scale, scale)
            return (N.ard_from_moments(count, unit[:p, :p], unit[:p, p], unit[p, p]) * scale[p] / scale[:p]).tolist()

        return pd.Series([one(*row) for row in zip(n, covs)])

    udf = F.pandas_udf(solve, ArrayType(DoubleType()))
    return G.coefficients(m.select(*keys, udf("n", "covs").alias("coef")), keys, xs)


# ------------------------------------------------------------------ trend with bends and a yearly wave


def bend_columns(t: str, total: Column, bends: int, waves: int, period: float = 12.0) -> dict[str, Column]:
    """Piecewise-linear trend over the first four fifths of the series, and Fourier terms of one year."""
    out = {"_t": F.col(t) / total}
    for j in range(1, bends + 1):
        out[f"_k{j}"] = F.greatest(F.col(t) / total - 0.8 * j / (bends + 1), F.lit(0.0))
    for k in range(1, waves + 1):
        out[f"_ws{k}"], out[f"_wc{k}"] = F.sin(F.col(t) * (2 * np.pi * k / period)), F.cos(F.col(t) * (2 * np.pi * k / period))
    return out


def additive_forecast(df: DataFrame, keys: Sequence[str], t: str, value: str, steps: int, bends: int = 4, waves: int = 3, ridge: float = 0.01) -> DataFrame:
    """Additive trend-and-season forecast: ``keys, t, forecast``.  Stands in for a Bayesian additive model."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.select(*keys, t, value).withColumn("_n", total)
    cols = bend_columns(t, F.col("_n"), bends, waves)
    model = G.fit(rows.withColumns(cols), keys, list(cols), value, ridge=ridge)
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"), F.count(F.lit(1)).alias("_n"))
    ahead = last.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn(t, F.col("_last") + F.col("_h"))
    out = ahead.join(model.select(*keys, "coef", "intercept"), list(keys)).withColumns(cols)
    return out.select(*keys, t, G.linear(list(cols)).alias("forecast"))


def mean_forecast(df: DataFrame, keys: Sequence[str], value: str, steps: int) -> DataFrame:
    """A constant forecast at the training mean."""
    return FC.mean_features(df, keys, [value], steps).withColumnRenamed(value, "forecast")
