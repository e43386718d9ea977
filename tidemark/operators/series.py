"""Window operators over calendar series.

Each takes series keys as the partition.  A calendar series has one row per
period, so the calendar bounds every window partition however many facts it was
reduced from.  Observation-level series go through :mod:`blocked`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: Sequence[str], order: str | Sequence[str]):
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def with_index(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str = "t") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(by(keys, order)) - 1).cast("long"))


def lags(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], steps: Iterable[int]) -> DataFrame:
    w = by(keys, order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in steps})


def rolling_mean(value: str, keys: Sequence[str], order: str, k: int, full: bool) -> Column:
    """Trailing mean over ``k`` rows; ``full`` leaves rows NULL until ``k`` values are present."""
    w = by(keys, order).rowsBetween(-(k - 1), 0)
    mean = F.avg(value).over(w)
    return F.when(F.count(value).over(w) == k, mean) if full else mean


def rolling_corr(x: str, y: str, keys: Sequence[str], order: str, before: int, after: int) -> Column:
    """Pearson correlation over a row frame, present only where the frame is whole."""
    w = by(keys, order).rowsBetween(-before, after)
    return F.when(F.count(F.lit(1)).over(w) == before + after + 1, F.corr(x, y).over(w))


def diff(value: str, keys: Sequence[str], order: str) -> Column:
    return F.col(value) - F.lag(value, 1).over(by(keys, order))


def gradient(value: str, keys: Sequence[str], order: str) -> Column:
    """Central difference with one-sided differences at both ends."""
    w = by(keys, order)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    return F.coalesce((nxt - prev) / 2.0, nxt - F.col(value), F.col(value) - prev)


def anomaly(value: str, keys: Sequence[str], by_cols: Sequence[str] = ("month",)) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*keys, *by_cols))


def standardise(value: str, keys: Sequence[str], ddof: int) -> Column:
    w = Window.partitionBy(*keys)
    spread = (F.stddev_samp(value) if ddof else F.stddev_pop(value)).over(w)
    return F.try_divide(F.col(value) - F.avg(value).over(w), spread)


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank from 1, equal values sharing the mean of their ranks."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    tied = Window.partitionBy(*keys, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Linear interpolation by row position; values before the first and after the last are held flat."""
    idx = with_index(df, keys, order, "_i")
    back = by(keys, "_i").rowsBetween(Window.unboundedPreceding, 0)
    ahead = by(keys, "_i").rowsBetween(0, Window.unboundedFollowing)
    filled = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        a = F.last(known, ignorenulls=True).over(back)
        b = F.first(known, ignorenulls=True).over(ahead)
        step = (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / (b["i"] - a["i"])
        filled[c] = F.coalesce(F.col(c), a["v"] + step, a["v"], b["v"])
    return idx.withColumns(filled).drop("_i")


def detrended(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Add ``trend`` (OLS on the index) and ``detrended``."""
    w = Window.partitionBy(*keys)
    slope = F.regr_slope(F.col(value), F.col(t)).over(w)
    icept = F.regr_intercept(F.col(value), F.col(t)).over(w)
    return df.withColumn("trend", icept + slope * F.col(t)).withColumn("detrended", F.col(value) - F.col("trend"))


def deseasonalised(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Add ``trend``, ``seasonal`` (monthly mean of the detrended series) and ``residual``."""
    d = detrended(df, keys, t, value)
    d = d.withColumn("seasonal", F.avg("detrended").over(Window.partitionBy(*keys, "month")))
    return d.withColumn("residual", F.col("detrended") - F.col("seasonal"))


def ring_neighbours(df: DataFrame, keys: Sequence[str], seq: str, cols: Sequence[str]) -> DataFrame:
    """Previous and next vertex of a closed ring, wrapping at its ends."""
    w = by(keys, seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extra = {}
    for c in cols:
        extra[f"prev_{c}"] = F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
        extra[f"next_{c}"] = F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return df.withColumns(extra)


def month_range(spark, start: str, end: str) -> DataFrame:
    """Every first-of-month between two dates, made where it is used rather than collected."""
    return (
        spark.range(1)
        .select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("date"))
        .withColumns({"year": F.year("date").cast("long"), "month": F.month("date").cast("long")})
    )


def calendar_grid(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Each row of ``df`` for every year and month of the range."""
    years = df.withColumn("year", F.explode(F.sequence(F.lit(first_year).cast("long"), F.lit(last_year).cast("long"))))
    return years.withColumn("month", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))))


def hash_normal(seed: int, *cols: str) -> Column:
    """Standard normal noise that depends only on a seed and the row's columns (Box-Muller on two hashes).

    Unlike ``randn`` it does not change with partitioning or when a task runs again.
    """
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(2**52)) + 0.5) / float(2**52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))


def synthetic_trend(t: str, base: float, slope: float, sd: float, seed: int, *cols: str) -> Column:
    """A stand-in covariate ``base + slope t + noise`` for rows keyed by ``cols``."""
    return F.lit(base) + slope * F.col(t) + sd * hash_normal(seed, *cols)
