"""Additive attributions of tree ensembles: exact Shapley values over the paths of Spark ML trees.

A leaf's value reaches a row if every feature on its path lets the row through; a feature that is not known lets
through the share of the training weight that its splits do. Over the features of one path this game is a product, so
the Shapley value of a feature is an integral of the other features' factors along a line from unknown to known, a
polynomial that Gauss-Legendre nodes integrate without error. The model is a table of nodes; rows stay where they are
and are attributed in batches, all leaves at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import inference as I
from tidemark.operators import ml as M

#: Numbers held at once while rows meet leaves.
AT_ONCE = 2_000_000

NODES = "tree int, weight double, node int, feature int, threshold double, left int, right int, cover double, value double"


def node_rows(model) -> list[tuple]:
    """The nodes of a fitted tree ensemble: ``tree, weight, node, feature, threshold, left, right, cover, value``; leaves have no feature."""
    out = []
    weights = [1.0 / len(model.trees)] * len(model.trees) if "RandomForest" in type(model).__name__ else list(model.treeWeights)
    for tree, (fitted, weight) in enumerate(zip(model.trees, weights)):
        waiting, count = [(0, fitted._java_obj.rootNode())], 1
        while waiting:
            at, node = waiting.pop()
            cover, value = float(node.impurityStats().count()), float(node.prediction())
            if node.subtreeDepth() == 0:
                out.append((tree, weight, at, None, None, None, None, cover, value))
                continue
            split = node.split()
            if not split.getClass().getSimpleName().startswith("Continuous"):
                raise ValueError("attributions need continuous splits")
            out.append((tree, weight, at, split.featureIndex(), float(split.threshold()), count, count + 1, cover, value))
            waiting += [(count, node.leftChild()), (count + 1, node.rightChild())]
            count += 2
    return out


def node_table(spark: SparkSession, model) -> DataFrame:
    """The nodes of an ensemble as rows; its size is that of the model."""
    return spark.createDataFrame(node_rows(model), NODES)


class Paths(NamedTuple):
    """Leaves by the features on their paths, padded with a feature that always lets through."""

    value: np.ndarray  # leaf: weight times prediction
    feature: np.ndarray  # leaf by depth
    low: np.ndarray  # a row passes if low < x <= high
    high: np.ndarray
    share: np.ndarray  # of the weight that an unknown feature lets through

    @property
    def base(self) -> float:
        """The mean prediction over the training weight: all features unknown."""
        return float((self.value * self.share.prod(axis=1)).sum())


def paths(model) -> Paths:
    """The paths of all leaves of a model; splits of one feature on a path are one interval."""
    nodes: dict[int, dict[int, tuple]] = {}
    for tree, *node in node_rows(model):
        nodes.setdefault(tree, {})[node[1]] = node
    leaves = []
    for tree in nodes.values():
        waiting = [(0, {})]
        while waiting:
            at, path = waiting.pop()
            weight, _, feature, threshold, left, right, cover, value = tree[at]
            if feature is None:
                leaves.append((weight * value, path))
                continue
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            waiting.append((left, {**path, feature: (low, min(high, threshold), share * tree[left][6] / cover)}))
            waiting.append((right, {**path, feature: (max(low, threshold), high, share * tree[right][6] / cover)}))
    depth = max(1, max(len(p) for _, p in leaves))
    shape = (len(leaves), depth)
    out = Paths(np.array([v for v, _ in leaves]), np.zeros(shape, int), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape))
    for i, (_, path) in enumerate(leaves):
        for j, (feature, (low, high, share)) in enumerate(path.items()):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = feature, low, high, share
    return out


def attributed(x: np.ndarray, p: Paths) -> np.ndarray:
    """Attributions of rows (rows by features): each sums to the row's prediction minus :attr:`Paths.base`."""
    leaves, depth = p.feature.shape
    nodes, weights = np.polynomial.legendre.leggauss(math.ceil(depth / 2))
    nodes, weights = (nodes + 1) / 2, weights / 2
    to_feature = np.zeros((leaves * depth, x.shape[1]))
    to_feature[np.arange(leaves * depth), p.feature.ravel()] = 1.0
    out = np.empty(x.shape)
    rows = max(1, AT_ONCE // (leaves * depth))
    for first in range(0, len(x), rows):
        at = x[first : first + rows][:, p.feature]
        known = ((at > p.low) & (at <= p.high)).astype(float)
        total = np.zeros(known.shape)
        for t, w in zip(nodes, weights):
            factor = p.share * (1 - t) + known * t
            total += w * factor.prod(axis=2, keepdims=True) / factor
        total *= (known - p.share) * p.value[:, None]
        out[first : first + rows] = total.reshape(len(total), -1) @ to_feature
    return out


def attributions(model, xs: Sequence[str]) -> Column:
    """The attributions of a row as an array in the order of ``xs``; null where a feature is null."""
    p = paths(model)

    @F.pandas_udf("array<double>")
    def attribute(values: pd.Series) -> pd.Series:
        out = np.full(len(values), None, object)
        whole = [i for i, v in enumerate(values) if v is not None]
        if whole:
            for i, row in zip(whole, attributed(np.stack([np.asarray(values.iloc[i], float) for i in whole]), p)):
                out[i] = row
        return pd.Series(out)

    features = F.array(*[F.col(x).cast("double") for x in xs])
    present = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in xs])
    return attribute(F.when(present, features))


def importance(df: DataFrame, model, xs: Sequence[str], top: int | None = 20) -> DataFrame:
    """Mean absolute attribution by feature: ``place, name, importance``, the ``top`` first of them."""
    rows = df.select(attributions(model, xs).alias("_a"))
    means = rows.agg(*[F.avg(F.abs(F.col("_a")[i])).alias(f"_i{i}") for i in range(len(xs))])
    named = F.array(*[F.struct((-F.col(f"_i{i}")).alias("_i"), F.lit(x).alias("name")) for i, x in enumerate(xs)])
    ordered = means.select(F.posexplode(F.array_sort(named)).alias("_p", "_s"))
    out = ordered.select((F.col("_p") + 1).cast("long").alias("place"), "_s.name", (-F.col("_s._i")).alias("importance"))
    return out.where(F.col("place") <= top) if top else out


def elimination(df: DataFrame, idx: str, estimator, xs: Sequence[str], label: str, folds: int = 5) -> DataFrame:
    """Features dropped one at a time from the least attribution on: ``n_features, features, removed, r2``.

    The order comes from one model of all features. Each size is judged by ``folds`` tests in time: blocks of
    equal length of ``idx`` at the end of its range, each predicted by a model of all rows before it.
    """
    first, last = df.agg(F.min(idx), F.max(idx)).first()
    size = (last - first + 1) // (folds + 1)
    order = [r["name"] for r in importance(df, estimator.fit(M.assemble(df, xs)), xs, None).orderBy("place").collect()]  # one row per feature
    sizes = [order[:n] for n in range(len(order), 0, -1)]
    starts = [last + 1 - (folds - k) * size for k in range(folds)]
    assembled = [M.assemble(df, names) for names in sizes]
    jobs = [lambda d=d, start=start: estimator.fit(d.where(F.col(idx) < start)) for d in assembled for start in starts]
    models = iter(M.together(df.sparkSession, jobs))
    steps = []
    for names, data in zip(sizes, assembled):
        tests = []
        for k, start in enumerate(starts):
            tested = next(models).transform(data.where((F.col(idx) >= start) & (F.col(idx) < start + size)))
            tests.append(tested.select(F.lit(k).alias("fold"), F.col(label).alias("actual"), "prediction"))
        score = I.metrics(reduce(DataFrame.unionByName, tests), ["fold"], "actual", "prediction").agg(F.avg("r2").alias("r2"))
        removed = order[len(names)] if len(names) < len(order) else None
        steps.append(score.select(F.lit(len(names)).cast("long").alias("n_features"), F.lit(",".join(names)).alias("features"), F.lit(removed).cast("string").alias("removed"), "r2"))
    return reduce(DataFrame.unionByName, steps)
