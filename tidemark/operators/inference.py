"""Hypothesis tests, correlation and multiple-testing control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.functions import columns as C
from tidemark.functions.special import t_p_value
from tidemark.operators import blocked as B
from tidemark.operators import series as S
from tidemark.operators.concordance import ranked
from tidemark.session import cut_lineage

# ------------------------------------------------------------------ two samples


def group_moments(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    return df.groupBy(*keys, group).agg(
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("var"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("n"),
    )


def side_by_side(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str) -> DataFrame:
    """One row per key with the measures of group ``a`` and of group ``b`` prefixed by their names."""
    measures = [c for c in df.columns if c not in (*keys, group)]
    pick = lambda g, m: F.max(F.when(F.col(group) == g, F.col(m))).alias(f"{g.lower()}_{m}")
    return df.groupBy(*keys).agg(*[pick(g, m) for g in (a, b) for m in measures])


def welch(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Welch's t test of group ``a`` against group ``b``, from per-group moments."""
    w = side_by_side(group_moments(df.where(F.col(group).isin(a, b)), keys, group, value), keys, group, a, b)
    pa, pb = a.lower(), b.lower()
    va, vb = F.col(f"{pa}_var") / F.col(f"{pa}_n"), F.col(f"{pb}_var") / F.col(f"{pb}_n")
    t = F.try_divide(F.col(f"{pa}_mean") - F.col(f"{pb}_mean"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) * (va + vb), va * va / (F.col(f"{pa}_n") - 1) + vb * vb / (F.col(f"{pb}_n") - 1))
    return w.withColumns({"t_stat": t, "dof": dof}).withColumn("t_p", t_p_value("t_stat", "dof"))


@F.pandas_udf(DoubleType())
def exact_mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided exact p of U without ties, for a smaller sample of at most eight."""

    def one(u_, a, b):
        if np.isnan(u_):
            return np.nan
        small, large = int(min(a, b)), int(max(a, b))
        counts = np.zeros(small * large + 1)
        counts[0] = 1.0
        for i in range(1, small + 1):  # Gaussian binomial coefficient, one factor at a time
            up = counts.copy()
            up[large + i :] -= counts[: max(len(counts) - large - i, 0)]
            for start in range(i):
                up[start::i] = np.cumsum(up[start::i])
            counts = np.round(up)
        top = int(np.ceil(max(u_, a * b - u_)))
        return min(1.0, 2 * counts[top:].sum() / counts.sum())

    return pd.Series([one(*row) for row in zip(u, n1, n2)])


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str, parts: int = 64) -> DataFrame:
    """Mann-Whitney U, two-sided: exact for small samples without ties, else normal with both corrections.

    Equal values are counted before ranking and ranks are built per value block,
    so neither sample is ever gathered.
    """
    clean = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    is_a = F.when(F.col(group) == a, 1).otherwise(0)
    counts = B.value_counts(clean, keys, value, parts, _ca=F.sum(is_a))
    ranked = B.running_sum(counts, [*keys], [value], "_c", F.col("_block"), "_upto")
    rank = F.col("_upto") - (F.col("_c") - 1) / 2.0
    c = F.col("_c").cast("double")
    g = ranked.groupBy(*keys).agg(
        F.sum("_ca").cast("double").alias("n1"),
        F.sum(F.col("_c") - F.col("_ca")).cast("double").alias("n2"),
        F.sum(rank * F.col("_ca")).alias("_r1"),
        F.sum(c * c * c - c).alias("_ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    g = g.withColumn("u_stat", F.col("_r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    top = F.greatest(F.col("u_stat"), n1 * n2 - F.col("u_stat"))
    z = F.try_divide(top - n1 * n2 / 2 - 0.5, sd)
    g = g.withColumn("_z", z)  # a column of its own: the distribution reads it many times
    normal = F.when(F.col("_z") > 0, C.normal_two_sided_p("_z")).otherwise(1.0)
    exact = (F.least(n1, n2) <= 8) & (F.col("_ties") == 0)
    p = F.when(exact, exact_mann_whitney_p(F.when(exact, F.col("u_stat")), n1, n2)).otherwise(normal)
    return g.select(*keys, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u_stat", p.alias("u_p"))


def compare_periods(df: DataFrame, keys: Sequence[str], group: str, low: str, high: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Composite comparison: moments of both periods, difference, Welch and Mann-Whitney p values."""
    w = welch(df, keys, group, low, high, value)
    u = mann_whitney(df, keys, group, low, high, value).select(*keys, "u_stat", "u_p")
    lo, hi = low.lower(), high.lower()
    diff = F.col(f"{hi}_mean") - F.col(f"{lo}_mean")
    out = w.join(u, list(keys)).withColumns({"diff": diff, "diff_pct": C.pct_change(f"{hi}_mean", f"{lo}_mean")})
    return out.withColumn("significant", C.significant("t_p", alpha)).drop(f"{lo}_var", f"{hi}_var")


# ------------------------------------------------------------------ correlation


def correlation_p(r: Column, n: Column, covariates: int = 0) -> tuple[Column, Column]:
    """t statistic and p value of a (partial) correlation."""
    dof = (n - 2 - covariates).cast("double")
    t = F.try_divide(r * F.sqrt(dof), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    return t, t_p_value(t, dof)


def pearson_of(x: str, y: str) -> Column:
    """Pearson correlation of the rows in which both are present, as an aggregate; null where one of them never changes."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(*keys).agg(pearson_of(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    t, p = correlation_p(F.col("r"), F.col("n"))
    return g.withColumn("t_stat", t).withColumn("p", p)


def correlation_pairs(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregation: ``keys, a, b, r``."""
    pairs = list(combinations(cols, 2))
    g = df.groupBy(*keys).agg(*[pearson_of(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return g.select(*keys, F.inline(cells))


def spearman_pairs(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    ranked = df.select(*keys, *[S.average_rank(c, keys).alias(c) for c in cols])
    return correlation_pairs(ranked, keys, cols)


@F.pandas_udf(ArrayType(DoubleType()))
def partial_from_correlations(upper: pd.Series, size: pd.Series) -> pd.Series:
    """Upper triangle of a correlation matrix to the upper triangle of partial correlations."""

    def one(values, p):
        m = np.eye(int(p))
        i, j = np.triu_indices(int(p), 1)
        m[i, j] = m[j, i] = values
        inv = np.linalg.pinv(m)
        d = np.sqrt(np.diag(inv))
        return list((-inv / np.outer(d, d))[i, j])

    return pd.Series([one(np.asarray(u, float), p) for u, p in zip(upper, size)])


def partial_correlation(df: DataFrame, keys: Sequence[str], target: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of ``target`` with each column given all the others, with p: ``keys, name, r, t_stat, p``."""
    names = [target, *cols]
    pairs = list(combinations(names, 2))
    clean = df.select(*keys, *names).na.drop(subset=names)
    g = clean.groupBy(*keys).agg(F.array(*[pearson_of(a, b) for a, b in pairs]).alias("_u"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("_partial", partial_from_correlations("_u", F.lit(len(names))))
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col("_partial")[pairs.index((target, c))].alias("r")) for c in cols])
    out = g.select(*keys, "n", F.inline(rows))
    t, p = correlation_p(F.col("r"), F.col("n"), len(cols) - 1)
    return out.withColumn("t_stat", t).withColumn("p", p).drop("n")


def lagged_correlation(df: DataFrame, keys: Sequence[str], order: str, y: str, x: str, steps: Sequence[int]) -> DataFrame:
    """``corr(y_t, x_{t-lag})`` for each lag: ``keys, lag, r, n``."""
    w = S.by(keys, order)
    wide = df.select(*keys, F.col(y).alias("_y"), *[F.lag(x, k).over(w).alias(f"_x{k}") for k in steps])
    both = lambda k: F.when(F.col(f"_x{k}").isNotNull() & F.col("_y").isNotNull(), 1)
    g = wide.groupBy(*keys).agg(
        *[pearson_of("_y", f"_x{k}").alias(f"r{k}") for k in steps], *[F.count(both(k)).alias(f"n{k}") for k in steps]
    )
    cells = F.array(*[F.struct(F.lit(int(k)).cast("long").alias("lag"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k in steps])
    return g.select(*keys, F.inline(cells))


def best_lag(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lag of the largest absolute correlation; the shorter lag wins a tie."""
    best = F.min(F.struct((-F.abs(F.col("r"))).alias("k"), F.col("lag"), F.col("r")))
    return correlations.where(F.col("r").isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.lag").alias("best_lag"), F.col("_b.r").alias("best_r")
    )


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, value: str, max_lag: int) -> DataFrame:
    """Sample autocorrelation with the full-series mean and variance: ``keys, lag, acf``."""
    centred = df.select(*keys, order, (F.col(value) - F.avg(value).over(Window.partitionBy(*keys))).alias("_d"))
    w = S.by(keys, order)
    wide = centred.select(*keys, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    g = wide.groupBy(*keys).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_c0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, max_lag + 1)]
    )
    cells = [F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(F.col(f"_c{k}"), F.col("_c0")).alias("acf")) for k in range(max_lag + 1)]
    return g.select(*keys, F.inline(F.array(*cells)))


@F.pandas_udf(ArrayType(DoubleType()))
def pacf_from_acf(acf: pd.Series) -> pd.Series:
    """Partial autocorrelations by Durbin-Levinson, from autocorrelations at lags 0, 1, ..."""

    def one(r):
        r = np.asarray(r, float)
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
            phi = np.append(phi - last * phi[::-1], last)
            out.append(float(last))
        return out

    return pd.Series([one(a) for a in acf])


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, lag, pacf`` from the rows of :func:`autocorrelation`."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"])  # one entry per lag
    g = acf.groupBy(*keys).agg(ordered.alias("_a")).withColumn("_p", pacf_from_acf("_a"))
    return g.select(*keys, F.posexplode("_p").alias("lag", "pacf")).withColumn("lag", F.col("lag").cast("long"))


# ------------------------------------------------------------------ extremes and adjustment


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, name: str = "p_adjusted") -> DataFrame:
    """Adjusted p values within a family of tests (one row per test)."""
    ordered = Window.partitionBy(*keys).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*keys))
    raw = df.withColumn("_raw", F.col(p) * m / F.row_number().over(ordered))
    # equal p values may take any order: the running minimum gives all of them the last one's value
    back = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(back), F.lit(1.0)))).drop("_raw")


def benjamini_hochberg_family(df: DataFrame, p: str, name: str = "p_adjusted", block: int = 65_536) -> DataFrame:
    """:func:`benjamini_hochberg` over one family of any number of tests, without a window over all of them.

    Tests are ranked from range-sorted partitions; the least adjusted value from a rank on is the lesser of that in
    its block of ranks and that of the blocks behind. Tests without p stay without an adjusted one.
    """
    tested = df.where(F.col(p).isNotNull())
    rows = cut_lineage(ranked(tested.select("*", F.lit(0).alias("_all")), ["_all"], [p], "_rank"))
    m = rows.count()
    rows = rows.withColumns({"_raw": F.col(p) * m / (F.col("_rank") + 1), "_b": F.floor(F.col("_rank") / block)})
    least = rows.groupBy("_all", "_b").agg(F.min("_raw").alias("_least"))
    behind = F.min("_least").over(Window.partitionBy("_all").orderBy("_b").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.join(least.select("_b", behind.alias("_behind")), "_b")
    inside = F.min("_raw").over(Window.partitionBy("_b").orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    out = rows.withColumn(name, F.least(inside, F.coalesce("_behind", F.lit(1.0)), F.lit(1.0))).drop("_all", "_rank", "_raw", "_b", "_behind")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def extremes(df: DataFrame, keys: Sequence[str], value: str, high: float = 0.9, low: float = 0.1, inclusive: bool = False) -> DataFrame:
    """Rows with ``is_high`` and ``is_low`` flags against their series' exact percentiles."""
    limits = df.groupBy(*keys).agg(F.percentile(value, high).alias("hi_limit"), F.percentile(value, low).alias("lo_limit"))
    rows = df.join(limits, list(keys))
    v = F.col(value)
    above = v >= F.col("hi_limit") if inclusive else v > F.col("hi_limit")
    under = v <= F.col("lo_limit") if inclusive else v < F.col("lo_limit")
    return rows.withColumns({"is_high": above, "is_low": under})


def extreme_counts(df: DataFrame, keys: Sequence[str], value: str, **limits) -> DataFrame:
    flag = lambda c: F.sum(F.col(c).cast("long"))
    g = extremes(df, keys, value, **limits).groupBy(*keys).agg(flag("is_high").alias("n_high"), flag("is_low").alias("n_low"), F.count(value).alias("n"))
    return g.withColumn("frequency_pct", 100.0 * (F.col("n_high") + F.col("n_low")) / F.col("n"))


def metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """R2, RMSE, MAE and MAPE of a prediction, in one aggregation."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    return df.where(a.isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        (1 - F.try_divide(F.sum(e * e), F.regr_syy(a, a))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100 * F.avg(F.abs(F.try_divide(e, a)))).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def composite_index(df: DataFrame, keys: Sequence[str], signs: Mapping[str, int], name: str = "index") -> DataFrame:
    """Mean of signed z scores (sample sd) of several columns."""
    z = [S.standardise(c, keys, ddof=1) * float(s) for c, s in signs.items()]
    total = z[0]
    for part in z[1:]:
        total = total + part
    return df.withColumn(name, total / float(len(z)))
