"""Relational reshaping: aggregation by calendar, pivots, outer-join chains, period composites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions import columns as C


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Add ``date`` (first of month), ``year`` and ``month`` derived from a timestamp."""
    return df.withColumn("date", C.month_start(ts)).withColumns(
        {"year": F.year("date").cast("long"), "month": F.month("date").cast("long")}
    )


def exact_mean(c: C.ColumnLike, scale: int) -> Column:
    """Mean of a fixed-point measure, summed in integers so the result does not depend on row order."""
    return F.sum(F.round(C.col(c) * scale).cast("long")).cast("double") / float(scale) / F.count(C.col(c))


def monthly_mean(df: DataFrame, ts: str, value: C.ColumnLike, keys: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """Calendar-month mean per key; rows without a timestamp are dropped, as a grouped mean drops null keys."""
    measure = exact_mean(value, scale) if scale else F.avg(C.col(value))
    return (
        with_calendar(df.where(F.col(ts).isNotNull()), ts)
        .groupBy(*keys, "date", "year", "month")
        .agg(measure.alias("value"), F.count(C.col(value)).alias("n_obs"))
    )


def annual_mean(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "year").agg(F.avg(value).alias("value"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def all_except(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def mean_all_numeric(df: DataFrame, keys: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Mean of every numeric column per key."""
    measures = numeric_columns(df, [*keys, *drop])
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in measures])


def pivot_mean(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence, value: str, prefix: str = "") -> DataFrame:
    """``keys`` x ``pivot`` table of means; listing the values spares Spark a pass to discover them."""
    wide = df.groupBy(*keys).pivot(pivot, list(values)).agg(F.avg(value))
    return wide.select(*keys, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def flux_wide(df: DataFrame, keys: Sequence[str], side: str, sides: Sequence[str], flows: Sequence[str] = ("inflow", "outflow")) -> DataFrame:
    """Long flux facts to ``{side}_{flow}`` columns: first present value, all inflows before all outflows."""
    wide = df.groupBy(*keys).pivot(side, list(sides)).agg(*[F.first(f, ignorenulls=True).alias(f) for f in flows])
    return wide.select(*keys, *[F.col(f"`{s}_{f}`") for f in flows for s in sides])


def flux_long(df: DataFrame, keys: Sequence[str], flows: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(flows), "flow", "value")


def outer_chain(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), "outer"), frames)


def left_chain(base: DataFrame, frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), "left"), frames, base)


def fill_with_mean(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Missing cells take their column's mean within ``keys``, or zero where the column is empty."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])
    filled = {c: F.coalesce(F.col(c), F.col(f"_mean_{c}"), F.lit(0.0)) for c in cols}
    return df.join(means, list(keys)).withColumns(filled).drop(*[f"_mean_{c}" for c in cols])


def first_distinct(df: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """Distinct coordinates in order of first appearance."""
    return df.groupBy(*cols).agg(F.min(order).alias(order))


def period_rows(spark, periods: Mapping[str, Sequence[int]]) -> DataFrame:
    """The period dimension ``(period, year)``; a year may belong to several periods."""
    rows = [F.struct(F.lit(name).alias("period"), F.lit(int(y)).cast("long").alias("year")) for name, years in periods.items() for y in years]
    return spark.range(1).select(F.inline(F.array(*rows)))


def composite(df: DataFrame, periods: DataFrame, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each measure over the years of each period."""
    joined = df.join(F.broadcast(periods), "year")  # a hand-written dimension: one row per named year
    return joined.groupBy(*keys, "period").agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("n"))


def describe_exact(df: DataFrame, value: str, keys: Sequence[str] = (), percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample sd, min, exact percentiles and max of calendar-bounded groups.

    Whole fact tables go through :func:`tidemark.operators.blocked.exact_quantiles`.
    """
    return df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        *[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in percentiles],
        F.max(value).alias("max"),
    )


def pending(tasks: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tasks whose result is not there yet: what a resumed run still has to compute."""
    return tasks.join(done, list(on), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed merge in which a new row replaces the old row of the same key."""
    return new.unionByName(old.join(new, list(keys), "left_anti"), allowMissingColumns=True)


def top_abs(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(value)).desc(), *ties).limit(k)


def arg_extreme(order: str, *carry: str, largest: bool = True) -> Column:
    """Aggregate row of the extreme ``order``; ties go to the smallest carried columns."""
    key = F.col(order) if not largest else -F.col(order)
    return F.min(F.struct(key.alias("_key"), *[F.col(c) for c in carry]))


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present among the columns, compared without case."""
    lowered = {c.lower(): c for c in df.columns}
    return next((lowered[c.lower()] for c in candidates if c.lower() in lowered), None)


def columns_matching(df: DataFrame, *fragments: str) -> list[str]:
    return [c for c in df.columns if any(f in c.lower() for f in fragments)]
