"""Tree ensembles, selection, stacking and components on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.operators import inference as I
from tidemark.operators import regress as G
from tidemark.operators.blocked import row_index
from tidemark.operators.regress import square
from tidemark.session import cut_lineage

#: Rows of one hash bucket in which a permutation numbers its rows.
BUCKET_ROWS = 10_000


def assemble(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="skip").transform(df)


def forest(trees: int = 200, depth: int = 8, leaf: int = 1, weight: str | None = None, seed: int = 42, label: str = "value") -> RandomForestRegressor:
    rf = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return rf.setWeightCol(weight) if weight else rf


def boosted(rounds: int = 200, rate: float = 0.05, depth: int = 4, subsample: float = 1.0, seed: int = 42, label: str = "value") -> GBTRegressor:
    return GBTRegressor(labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=seed)


def importances(spark, model, xs: Sequence[str]) -> DataFrame:
    """Impurity importances of a fitted ensemble, one row per feature."""
    rows = [F.struct(F.lit(x).alias("name"), F.lit(float(v)).alias("importance")) for x, v in zip(xs, model.featureImportances.toArray())]
    return spark.range(1).select(F.inline(F.array(*rows)))


def permutation_importance(df: DataFrame, model, xs: Sequence[str], order: Sequence[str], seed: int = 0, prediction: str = "prediction") -> DataFrame:
    """Mean absolute change of the prediction when one feature is shuffled: ``name, importance``.

    The shuffle is a true permutation: the row of each rank by one hash takes the value of the row that has this rank
    by another hash, one for each feature. Ranks come from counts of hash buckets, so no task sees a global order, and
    all features are scored in one pass.
    """
    rows = cut_lineage(df.select(*order, *xs).na.drop(subset=list(xs)))
    bits = max(1, math.ceil(math.log2(max(1, rows.count()) / BUCKET_ROWS)))
    bucket = F.shiftright("_h", 64 - bits)
    takers = model.transform(assemble(rows, xs)).select(*order, *xs, F.col(prediction).alias("_base"), F.xxhash64(F.lit(seed), *order).alias("_h"))
    takers = row_index(takers, [], ["_h", *order], bucket, "_rank").drop("_h")
    given = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(x).cast("double").alias("_swap"), F.xxhash64(F.lit(seed + i + 1), *order).alias("_h")) for i, x in enumerate(xs)])
    donors = row_index(rows.select(*order, F.inline(given)), ["_f"], ["_h", *order], bucket, "_rank").select("_f", "_rank", "_swap")
    each = takers.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(xs))]))).join(donors, ["_f", "_rank"])
    mixed = each.withColumns({x: F.when(F.col("_f") == i, F.col("_swap")).otherwise(F.col(x)) for i, x in enumerate(xs)})
    out = model.transform(assemble(mixed, xs)).groupBy("_f").agg(F.avg(F.abs(F.col(prediction) - F.col("_base"))).alias("importance"))
    return out.select(F.array(*[F.lit(x) for x in xs])[F.col("_f")].alias("name"), "importance")


def linear_attributions(df: DataFrame, model: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Exact additive attributions of a linear model, as mean absolute contributions: ``keys, name, importance``.

    The contribution of a feature is its coefficient times its distance from the mean.
    """
    means = df.groupBy(*keys).agg(*[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)])
    rows = df.join(means, list(keys)).join(model.select(*keys, "coef"), list(keys))
    g = rows.groupBy(*keys).agg(*[F.avg(F.abs(F.col("coef")[i] * (F.col(x) - F.col(f"_m{i}")))).alias(f"_i{i}") for i, x in enumerate(xs)])
    return g.select(*keys, F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"_i{i}").alias("importance")) for i, x in enumerate(xs)])))


def recursive_elimination(df: DataFrame, xs: Sequence[str], keep: int, estimator) -> list[str]:
    """Drop the least important feature until ``keep`` remain."""
    left = list(xs)
    while len(left) > keep:
        model = estimator.fit(assemble(df, left))
        left.pop(int(np.argmin(model.featureImportances.toArray())))
    return left


def selected_by_both(by_penalty: Sequence[str], by_elimination: Sequence[str], at_least: int = 3) -> list[str]:
    """Features both selections chose, or the eliminated list's survivors when too few agree."""
    both = [x for x in by_elimination if x in set(by_penalty)]
    return both if len(both) >= at_least else list(by_elimination)


def backward_elimination(df: DataFrame, keys: Sequence[str], idx: str, xs: Sequence[str], y: str, folds: int = 4, keep: int = 1) -> DataFrame:
    """Drop features by attribution, one at a time, with the validation error at each size.

    Each size costs one pass; features are ranked over all series.
    """
    left, steps = list(xs), []
    while len(left) >= keep:
        model = G.fit(df, keys, left, y)
        cv = G.time_series_cv(df, keys, idx, left, y, folds).agg(F.avg("mse").alias("mse"))
        ranked = linear_attributions(df, model, keys, left).groupBy("name").agg(F.avg("importance").alias("i")).orderBy("i", "name").first()["name"]
        steps.append(cv.select(F.lit(len(left)).cast("long").alias("n_features"), F.lit(",".join(left)).alias("features"), "mse"))
        left = [x for x in left if x != ranked]
        if not left:
            break
    return reduce(DataFrame.unionByName, steps)


def together(spark: SparkSession, jobs: Sequence[Callable], parallelism: int = 4) -> list:
    """Results of independent fits, ``parallelism`` of them submitted to Spark at a time."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)


def _fold_fits(data: DataFrame, fold: str, estimators: Sequence) -> tuple[list, list]:
    """The fold labels, and for each estimator its models fitted without each fold."""
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())  # the fold labels, a handful
    jobs = [lambda e=e, k=k: e.fit(data.where(F.col(fold) != k)) for e in estimators for k in folds]
    models = together(data.sparkSession, jobs)
    return folds, [models[i * len(folds) : (i + 1) * len(folds)] for i in range(len(estimators))]


def cross_validate(df: DataFrame, fold: str, estimator, xs: Sequence[str], label: str) -> DataFrame:
    """Predictions of each fold by a model fitted on the others."""
    return _cross_validated(df, fold, [estimator], xs, label)[0]


def _cross_validated(df: DataFrame, fold: str, estimators: Sequence, xs: Sequence[str], label: str) -> list[DataFrame]:
    data = assemble(df, xs)
    folds, models = _fold_fits(data, fold, estimators)
    parts = [[m.transform(data.where(F.col(fold) == k)) for k, m in zip(folds, of)] for of in models]
    return [reduce(DataFrame.unionByName, p).select(fold, F.col(label).alias("actual"), "prediction") for p in parts]


def random_fold(k: int, *order: str, seed: int = 42) -> F.Column:
    """Shuffled fold label by hash: the same rows land in the same fold in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(k))


def grid_search(df: DataFrame, fold: str, candidates: dict, xs: Sequence[str], label: str) -> DataFrame:
    """Error of each named estimator over the folds, best first."""
    tested = _cross_validated(df, fold, list(candidates.values()), xs, label)
    scores = [I.metrics(t, [], "actual", "prediction").select(F.lit(n).alias("candidate"), "rmse", "r2") for n, t in zip(candidates, tested)]
    return reduce(DataFrame.unionByName, scores).orderBy("rmse")


def stack(df: DataFrame, fold: str, estimators: dict, xs: Sequence[str], label: str, order: Sequence[str], ridge: float = 1.0) -> DataFrame:
    """Out-of-fold predictions of several estimators combined by ridge: rows with ``stacked``."""
    data = assemble(df, xs)
    folds, models = _fold_fits(data, fold, list(estimators.values()))
    wide = df.select(*order, F.col(label).alias("actual"))
    for name, of in zip(estimators, models):
        parts = [m.transform(data.where(F.col(fold) == k)).select(*order, F.col("prediction").alias(name)) for k, m in zip(folds, of)]
        wide = wide.join(reduce(DataFrame.unionByName, parts), list(order))
    meta = G.fit(wide, [], list(estimators), "actual", ridge=ridge)
    return G.predict_with(wide, meta, list(estimators), "stacked")


# ------------------------------------------------------------------ components


def principal_components(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int = 2) -> DataFrame:
    """Loadings of standardised columns from their correlations: ``keys, component, name, loading, variance_share``.

    Each component's largest loading is positive.
    """
    m = G.moments(df, keys, cols)
    p = len(cols)

    def solve(covs: pd.Series) -> pd.Series:
        def one(c):
            cov = square(np.asarray(c, float), p)
            sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
            values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
            out = []
            for j in np.argsort(-values, kind="stable")[:k]:
                v = vectors[:, j] * np.sign(vectors[np.argmax(np.abs(np.round(vectors[:, j], 12))), j])
                out += [*v.tolist(), float(values[j] / values.sum())]
            return out

        return pd.Series([one(c) for c in covs])

    udf = F.pandas_udf(solve, ArrayType(DoubleType()))
    g = m.select(*keys, udf("covs").alias("_v"))
    rows = [
        F.struct(F.lit(j + 1).cast("long").alias("component"), F.lit(c).alias("name"), F.col("_v")[j * (p + 1) + i].alias("loading"), F.col("_v")[j * (p + 1) + p].alias("variance_share"))
        for j in range(k)
        for i, c in enumerate(cols)
    ]
    return g.select(*keys, F.inline(F.array(*rows)))
