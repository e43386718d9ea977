"""Regression from sufficient statistics.

Spark reduces the rows of each key to means and cross products (map-side
combined, a few numbers per key however many rows), and only those reach the
small linear solves.  One reduction serves every lag subset, fold and penalty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.functions.special import f_p_value
from tidemark.operators import series as S
from tidemark.session import cut_lineage

WIDE = 12  # above this many columns the pairwise aggregates outgrow generated code, so batches are multiplied instead


def triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def moment_exprs(cols: Sequence[str], over=None) -> list[Column]:
    """Count, means and population covariances (upper triangle) as aggregates or window expressions."""
    put = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return [
        put(F.count(F.lit(1))).alias("n"),
        F.array(*[put(F.avg(c)) for c in cols]).alias("means"),
        F.array(*[put(F.covar_pop(cols[i], cols[j])) for i, j in triangle(len(cols))]).alias("covs"),
    ]


def moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``keys, n, means, covs`` over rows in which every column is present."""
    clean = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=list(cols))
    if len(cols) <= WIDE:
        return clean.groupBy(*keys).agg(*moment_exprs(cols))
    if not keys:
        return _wide_moments(clean.select(F.lit(0).alias("_all"), F.array(*cols).alias("_v")), ["_all"], len(cols)).drop("_all")
    return _wide_moments(clean.select(*keys, F.array(*cols).alias("_v")), keys, len(cols))


def _wide_moments(rows: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Moments of vectors: each Arrow batch is reduced to one centred product sum per key, then Spark adds them up."""
    means = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("_v")[i]) for i in range(p)]).alias("means")))
    joined = rows.join(means.drop("n"), list(keys))
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = StructType([*fields, StructField("_g", ArrayType(DoubleType()))])
    upper = np.triu_indices(p)
    names = [f.name for f in fields]

    def partial(batches):
        for pdf in batches:
            for _, part in pdf.groupby(names, sort=False):
                d = np.stack(part["_v"].to_numpy()) - np.stack(part["means"].to_numpy())
                yield pd.DataFrame({**{k: [part[k].iloc[0]] for k in names}, "_g": [(d.T @ d)[upper]]})

    cells = joined.mapInPandas(partial, schema).select(*keys, F.posexplode("_g").alias("_i", "_s"))
    summed = cells.groupBy(*keys, "_i").agg(F.sum("_s").alias("_s"))
    whole = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_c"))  # p (p + 1) / 2 cells per key
    return means.join(whole, list(keys)).select(*keys, "n", "means", F.transform("_c", lambda c: c["_s"] / F.col("n")).alias("covs"))


def square(covs: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    i, j = np.array(triangle(p)).T
    m[i, j] = m[j, i] = covs
    return m


def solve_penalised(cov: np.ndarray, n: float, xs: Sequence[int], y: int, ridge: float = 0.0, lasso: float = 0.0) -> np.ndarray:
    """Coefficients from covariances: least squares, ridge (sum-of-squares scale) or lasso (mean scale)."""
    sxx, sxy = cov[np.ix_(xs, xs)], cov[xs, y]
    if lasso:
        b, d = np.zeros(len(xs)), np.diag(sxx)
        for _ in range(10_000):
            old = b.copy()
            for k in range(len(xs)):
                rho = sxy[k] - sxx[k] @ b + d[k] * b[k]
                b[k] = np.sign(rho) * max(abs(rho) - lasso, 0.0) / d[k] if d[k] > 0 else 0.0
            if np.abs(b - old).max() <= 1e-13 * max(1.0, np.abs(b).max()):
                break
        return b
    if ridge:
        return np.linalg.solve(sxx + ridge / n * np.eye(len(xs)), sxy)
    scale = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    return np.linalg.lstsq(sxx / np.outer(scale, scale), sxy / scale, rcond=1e-12)[0] / scale


def solve_batch(cov: np.ndarray, n: np.ndarray, p: int, ridge: float = 0.0, lasso: float = 0.0) -> np.ndarray:
    """:func:`solve_penalised` for a stack of covariance matrices whose last column is the target."""
    if lasso:
        return np.stack([solve_penalised(c, k, list(range(p)), p, ridge, lasso) for c, k in zip(cov, n)])
    sxx, sxy = cov[:, :p, :p], cov[:, :p, p]
    if ridge:
        return np.linalg.solve(sxx + (ridge / n)[:, None, None] * np.eye(p), sxy[:, :, None])[:, :, 0]
    diagonal = np.diagonal(sxx, axis1=1, axis2=2)
    scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    inverse = np.linalg.pinv(sxx / (scale[:, :, None] * scale[:, None, :]), rcond=1e-12, hermitian=True)
    return (inverse @ (sxy / scale)[:, :, None])[:, :, 0] / scale


MODEL = StructType(
    [StructField("coef", ArrayType(DoubleType())), StructField("intercept", DoubleType()), StructField("rss", DoubleType()), StructField("tss", DoubleType())]
)


def solver(p: int, ridge: float = 0.0, lasso: float = 0.0, min_n: int = 1, origin: bool = False):
    """A UDF from moments of ``p`` predictors and a target (last) to the fitted model.

    ``origin`` fits without an intercept, on raw instead of centred products.
    """

    @F.pandas_udf(MODEL)
    def solve(n: pd.Series, means: pd.Series, covs: pd.Series) -> pd.DataFrame:
        usable = [m is not None and count >= min_n and not any(v is None or v != v for v in c) for count, m, c in zip(n, means, covs)]
        out = np.full(len(n), None, object)
        out[:] = [(None, None, None, None)] * len(n)
        if at := np.flatnonzero(usable).tolist():
            counts = np.asarray(n.iloc[at], float)
            m = np.stack([np.asarray(x, float) for x in means.iloc[at]])
            cov = np.stack([square(np.asarray(c, float), p + 1) for c in covs.iloc[at]])
            tss = counts * cov[:, p, p]
            if origin:
                cov, m = cov + m[:, :, None] * m[:, None, :], np.zeros_like(m)
            b = solve_batch(cov, counts, p, ridge, lasso)
            sxy = cov[:, :p, p]
            rss = counts * (cov[:, p, p] - 2 * (b * sxy).sum(1) + np.einsum("ki,kij,kj->k", b, cov[:, :p, :p], b))
            intercept = m[:, p] - (b * m[:, :p]).sum(1)
            for i, *found in zip(at, b.tolist(), intercept.tolist(), np.maximum(rss, 0.0).tolist(), tss.tolist()):
                out[i] = tuple(found)
        return pd.DataFrame(out.tolist(), columns=["coef", "intercept", "rss", "tss"])

    return solve


def fit(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, ridge: float = 0.0, lasso: float = 0.0, origin: bool = False) -> DataFrame:
    """Linear model per key: ``keys, n, coef, intercept, rss, tss, r2``."""
    m = moments(df, keys, [*xs, y])
    m = m.withColumn("_m", solver(len(xs), ridge, lasso, origin=origin)("n", "means", "covs"))
    return m.select(*keys, "n", "_m.*").withColumn("r2", 1 - F.try_divide(F.col("rss"), F.col("tss")))


def linear(xs: Sequence[str | Column], coef: str = "coef", intercept: str = "intercept") -> Column:
    cols = [F.col(x) if isinstance(x, str) else x for x in xs]
    return reduce(lambda a, b: a + b, [F.col(coef)[i] * c for i, c in enumerate(cols)], F.col(intercept))


def predict(df: DataFrame, model: DataFrame, keys: Sequence[str], xs: Sequence[str], name: str = "prediction") -> DataFrame:
    return df.join(model.select(*keys, "coef", "intercept"), list(keys)).withColumn(name, linear(xs)).drop("coef", "intercept")


def predict_with(df: DataFrame, model: DataFrame, xs: Sequence[str], name: str = "prediction") -> DataFrame:
    """Apply a single fitted model (one row) to any rows: its few numbers become literals of the plan."""
    row = model.select("coef", "intercept").first()
    terms = [F.lit(float(b)) * F.col(x) for b, x in zip(row["coef"], xs)]
    return df.withColumn(name, reduce(lambda u, v: u + v, terms, F.lit(float(row["intercept"]))))


def coefficients(model: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """One row per predictor: ``keys, name, coefficient``."""
    names = F.array(*[F.lit(x) for x in xs])
    return model.select(*keys, F.posexplode("coef").alias("_i", "coefficient"), names.alias("_n")).select(*keys, F.col("_n")[F.col("_i")].alias("name"), "coefficient")


def equation(target: str, xs: Sequence[str], digits: int = 4) -> Column:
    """The fitted model as text."""
    terms = [F.format_string(f" + %.{digits}f*{x}", F.col("coef")[i]) for i, x in enumerate(xs)]
    return F.concat(F.format_string(f"{target} = %.{digits}f", F.col("intercept")), *terms)


# ------------------------------------------------------------------ rolling


def rolling_prediction(df: DataFrame, keys: Sequence[str], idx: str, xs: Sequence[str], y: str, window: int, min_rows: int = 13) -> DataFrame:
    """Regression over the previous ``window`` rows, predicting the current one.

    The first ``window`` rows take the mean of those rows.  Moments slide as window
    aggregates; only a short array per row reaches the solve.
    """
    w = S.by(keys, idx)
    cols = [*xs, y]
    moved = df.select("*", *moment_exprs(cols, w.rowsBetween(-window, -1)))
    start = F.avg(F.when(F.col(idx) < window, F.col(y))).over(Window.partitionBy(*keys))
    moved = moved.withColumn("_m", solver(len(xs), min_n=min_rows)("n", "means", "covs")).withColumn("_start", start)
    pred = reduce(lambda a, b: a + b, [F.col("_m.coef")[i] * F.col(x) for i, x in enumerate(xs)], F.col("_m.intercept"))
    return moved.withColumn("prediction", F.when(F.col(idx) < window, F.col("_start")).otherwise(pred)).drop("n", "means", "covs", "_m", "_start")


# ------------------------------------------------------------------ time-aware validation


def with_series_length(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), list(keys))


def test_fold(idx: str, k: int) -> Column:
    """Expanding-window fold in which a row is tested (1..k), 0 for rows only ever trained on.

    Each of the ``k`` test blocks has ``n // (k + 1)`` rows and the last one ends the series.
    """
    size = F.floor(F.col("n_rows") / (k + 1))
    return F.greatest(F.floor((F.col(idx) - (F.col("n_rows") - k * size)) / size) + 1, F.lit(0)).cast("long")


def fold_bounds(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``keys, fold, train_rows, test_start, test_end`` (positions, end exclusive)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("size", F.floor(F.col("n_rows") / (k + 1)))
    n = n.withColumn("fold", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    start = F.col("n_rows") - (k - F.col("fold") + 1) * F.col("size")
    return n.select(*keys, "fold", start.alias("train_rows"), start.alias("test_start"), (start + F.col("size")).alias("test_end"))


def chunk_moments(df: DataFrame, keys: Sequence[str], idx: str, xs: Sequence[str], y: str, k: int) -> DataFrame:
    """Moments of each test block, at most ``k + 1`` per key: all that validation needs."""
    folds = with_series_length(df, keys).withColumn("fold", test_fold(idx, k))
    return moments(folds, [*keys, "fold"], [*xs, y])


def time_series_cv(df: DataFrame, keys: Sequence[str], idx: str, xs: Sequence[str], y: str, k: int, ridges: Sequence[float] = (0.0,), lassos: Sequence[float] = ()) -> DataFrame:
    """Expanding-window validation of every penalty from one pass: ``keys, penalty, fold, n_test, mse, r2``."""
    chunks = chunk_moments(df, keys, idx, xs, y, k)
    p = len(xs)
    penalties = [("lasso", a) for a in lassos] if lassos else [("ridge", a) for a in ridges]
    schema = StructType(
        [*[f for f in chunks.schema.fields if f.name in keys]]
        + [StructField("penalty", DoubleType()), StructField("fold", LongType()), StructField("n_test", LongType()), StructField("mse", DoubleType()), StructField("r2", DoubleType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fold")
        parts = [(r.fold, r.n, np.asarray(r.means, float), square(np.asarray(r.covs, float), p + 1)) for r in pdf.itertuples()]
        out = []
        for fold, n_test, m_test, c_test in parts:
            before = [q for q in parts if q[0] < fold]
            if fold == 0 or not before:
                continue
            n = sum(q[1] for q in before)
            m = sum(q[1] * q[2] for q in before) / n
            c = sum(q[1] * (q[3] + np.outer(q[2] - m, q[2] - m)) for q in before) / n
            for kind, a in penalties:
                b = solve_penalised(c, n, list(range(p)), p, **{kind: a})
                bias = m_test[p] - (m[p] - b @ m[:p]) - b @ m_test[:p]
                mse = c_test[p, p] - 2 * b @ c_test[:p, p] + b @ c_test[:p, :p] @ b + bias**2
                out.append((a, fold, n_test, mse, 1 - mse / c_test[p, p] if c_test[p, p] > 0 else None))
        res = pd.DataFrame(out, columns=["penalty", "fold", "n_test", "mse", "r2"])
        for key in keys:
            res.insert(0, key, pdf[key].iloc[0])
        return res[[f.name for f in schema.fields]]

    return chunks.groupBy(*keys).applyInPandas(run, schema)


def best_penalty(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Penalty of the lowest mean test error; the larger one wins a tie."""
    mean = scores.groupBy(*keys, "penalty").agg(F.avg("mse").alias("mse"))
    best = F.min(F.struct("mse", (-F.col("penalty")).alias("p")))
    return mean.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.p")).alias("penalty"), F.col("_b.mse").alias("mse"))


# ------------------------------------------------------------------ selection


def forward_selection(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, min_gain: float = 0.005, max_features: int = 10) -> DataFrame:
    """Greedy choice by in-sample R2: ``keys, step, name, r2``, from one set of moments."""
    m = moments(df, keys, [*xs, y])
    names, p = list(xs), len(xs)
    schema = ArrayType(StructType([StructField("name", ArrayType(LongType())), StructField("r2", DoubleType())]))

    @F.pandas_udf(schema)
    def choose(n: pd.Series, covs: pd.Series) -> pd.Series:
        def one(count, c):
            cov = square(np.asarray(c, float), p + 1)
            chosen, score, steps = [], 0.0, []
            while len(chosen) < max_features:
                trial = []
                for k in (k for k in range(p) if k not in chosen):
                    b = solve_penalised(cov, count, [*chosen, k], p)
                    trial.append((b @ cov[[*chosen, k], p] / cov[p, p], -k))
                if not trial or max(trial)[0] - score < min_gain:
                    break
                score, k = max(trial)
                chosen.append(-k)
                steps.append({"name": [-k], "r2": float(score)})
            return steps

        return pd.Series([one(*row) for row in zip(n, covs)])

    labels = F.array(*[F.lit(x) for x in names])
    return m.select(*keys, F.posexplode(choose("n", "covs")).alias("_i", "_s")).select(
        *keys, (F.col("_i") + 1).cast("long").alias("step"), labels[F.col("_s.name")[0].cast("int")].alias("name"), F.col("_s.r2").alias("r2")
    )


# ------------------------------------------------------------------ lagged systems


def granger(df: DataFrame, keys: Sequence[str], order: str, y: str, x: str, max_lag: int) -> DataFrame:
    """Does the past of ``x`` help predict ``y``?  ``keys, lag, f_stat, p`` for each lag length.

    A row takes part in every lag length its history allows; unused lags are zero
    there, so all lag lengths share one aggregation.
    """
    w = S.by(keys, order)
    ys, xs = [f"_y{k}" for k in range(1, max_lag + 1)], [f"_x{k}" for k in range(1, max_lag + 1)]
    rows = df.select(*keys, order, F.col(y).alias("_y"), F.col(x).alias("_x")).na.drop()
    rows = rows.withColumns({**{f"_y{k}": F.lag("_y", k).over(w) for k in range(1, max_lag + 1)}, **{f"_x{k}": F.lag("_x", k).over(w) for k in range(1, max_lag + 1)}})
    rows = rows.withColumn("lag", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max_lag).cast("long"))))
    used = {c: F.when(F.lit(k) <= F.col("lag"), F.col(c)).otherwise(0.0) for k in range(1, max_lag + 1) for c in (f"_y{k}", f"_x{k}")}
    m = moments(rows.withColumns(used), [*keys, "lag"], [*ys, *xs, "_y"])
    size = 2 * max_lag

    @F.pandas_udf(ArrayType(DoubleType()))
    def both_rss(lag: pd.Series, n: pd.Series, covs: pd.Series) -> pd.Series:
        def one(k, count, c):
            cov = square(np.asarray(c, float), size + 1)

            def rss(cols):
                b = solve_penalised(cov, count, cols, size)
                return float(count * (cov[size, size] - b @ cov[cols, size]))

            own = list(range(k))
            return [rss(own), rss(own + [max_lag + i for i in range(k)])]

        return pd.Series([one(*row) for row in zip(lag, n, covs)])

    m = m.withColumn("_r", both_rss("lag", "n", "covs")).withColumn("dof", (F.col("n") - 2 * F.col("lag") - 1).cast("double"))
    m = m.where(F.col("n") >= 2 * F.col("lag") + 5)
    f = F.try_divide((F.col("_r")[0] - F.col("_r")[1]) / F.col("lag"), F.col("_r")[1] / F.col("dof"))
    m = m.withColumn("f_stat", f).withColumn("p", f_p_value("f_stat", F.col("lag").cast("double"), "dof"))
    return m.select(*keys, "lag", "f_stat", "p")


def granger_best(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag length of the smallest p value; the shorter one wins a tie."""
    best = F.min(F.struct("p", "lag"))
    return tests.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.lag").alias("best_lag"), F.col("_b.p").alias("p"), (F.col("_b.p") < 0.05).alias("significant"))


def var_forecast(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], lags: int, steps: int, differenced: bool = False) -> DataFrame:
    """Vector autoregression per key and its forecasts ``keys, step, <cols>``.

    On differences, forecasts are summed onto the last level.
    """
    w = S.by(keys, order)
    src = {c: (F.col(c) - F.lag(c).over(w) if differenced else F.col(c)).cast("double") for c in cols}
    base = df.select(*keys, order, *[F.col(c).alias(f"_level_{c}") for c in cols], *[e.alias(c) for c, e in src.items()]).na.drop()
    lagged = [f"{c}_lag{k}" for k in range(1, lags + 1) for c in cols]
    rows = S.lags(base, keys, order, cols, range(1, lags + 1))
    m = moments(rows, keys, [*lagged, *cols])
    recent = lambda prefix: F.array(*[F.max_by(f"{prefix}{c}", order) for c in cols])
    tails = S.lags(base, keys, order, cols, range(1, lags)) if lags > 1 else base
    history = F.max_by(F.array(*cols, *[F.col(f"{c}_lag{k}") for k in range(1, lags) for c in cols]), order)
    last = tails.groupBy(*keys).agg(history.alias("_hist"), recent("_level_").alias("_level"))
    p, q = len(lagged), len(cols)

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(n: pd.Series, means: pd.Series, covs: pd.Series, hist: pd.Series, level: pd.Series) -> pd.Series:
        def one(count, mean, c, h, lev):
            mean, cov = np.asarray(mean, float), square(np.asarray(c, float), p + q)
            h, out = np.asarray(h, float), []
            coef = [solve_penalised(cov, count, list(range(p)), p + j) for j in range(q)]
            for _ in range(steps):
                nxt = np.array([mean[p + j] + coef[j] @ (h - mean[:p]) for j in range(q)])
                out.append(nxt)
                h = np.concatenate([nxt, h])[:p]
            out = np.array(out)
            return (np.asarray(lev, float) + np.cumsum(out, axis=0) if differenced else out).tolist()

        return pd.Series([one(*row) for row in zip(n, means, covs, hist, level)])

    joined = m.join(last, list(keys)).select(*keys, F.posexplode(run("n", "means", "covs", "_hist", "_level")).alias("_s", "_v"))
    return joined.select(*keys, (F.col("_s") + 1).cast("long").alias("step"), *[F.col("_v")[j].alias(c) for j, c in enumerate(cols)])
