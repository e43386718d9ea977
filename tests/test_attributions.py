"""Tree attributions against the definition, over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attributions as A
from tidemark.operators import ml as M

XS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4)).round(1)  # ties at thresholds
    y = np.where(x[:, 0] > 0, x[:, 1], -x[:, 2]) + 0.1 * x[:, 3] + rng.normal(scale=0.1, size=300)
    pdf = pd.DataFrame(x, columns=XS).assign(value=y, t=range(300))
    return pdf, spark.createDataFrame(pdf)


def known_value(tree, x, known, at=0):
    """A tree's value where only some features are known; the others follow the training weight."""
    feature, threshold, left, right, cover, value = tree[at]
    if feature is None:
        return value
    if feature in known:
        return known_value(tree, x, known, left if x[feature] <= threshold else right)
    return sum(tree[c][4] / cover * known_value(tree, x, known, c) for c in (left, right))


def plain(model, x):
    trees = {}
    for tree, weight, node, *rest in A.node_rows(model):
        trees.setdefault(tree, (weight, {}))[1][node] = rest
    out = np.zeros(4)
    for weight, tree in trees.values():
        for i in range(4):
            for size in range(4):
                for s in combinations([j for j in range(4) if j != i], size):
                    share = factorial(size) * factorial(3 - size) / factorial(4)
                    out[i] += weight * share * (known_value(tree, x, {*s, i}) - known_value(tree, x, set(s)))
    return out


@pytest.mark.parametrize("kind", ["forest", "boosted", "stump"])
def test_equal_to_the_definition(data, kind):
    pdf, df = data
    estimator = {"forest": M.forest(trees=5, depth=5), "boosted": M.boosted(rounds=6, rate=0.3, depth=3), "stump": M.forest(trees=1, depth=1)}[kind]
    model = estimator.fit(M.assemble(df, XS))
    p = A.paths(model)
    x = pdf[XS].to_numpy()
    got = A.attributed(x, p)
    for i in range(0, 300, 25):
        assert np.allclose(got[i], plain(model, x[i]), atol=1e-10)
    predicted = model.transform(M.assemble(df, XS)).orderBy("t").toPandas()["prediction"].to_numpy()
    assert np.allclose(got.sum(1), predicted - p.base, atol=1e-9)


def test_column_with_nulls_and_batches(data, monkeypatch):
    pdf, df = data
    model = M.forest(trees=4, depth=4).fit(M.assemble(df, XS))
    holes = df.withColumn("b", F.when(F.col("t") % 7 != 0, F.col("b")))
    rows = holes.repartition(3).select("t", A.attributions(model, XS).alias("a")).orderBy("t").collect()
    assert [r.a is None for r in rows] == [i % 7 == 0 for i in range(300)]
    monkeypatch.setattr(A, "AT_ONCE", 500)
    small = A.attributed(pdf[XS].to_numpy(), A.paths(model))
    assert np.allclose(small[1], rows[1].a)
    table = A.node_table(df.sparkSession, model)
    assert table.where("feature is null").count() == len(A.paths(model).value)


def test_importance_and_elimination(data):
    _, df = data
    estimator = M.forest(trees=10, depth=5)
    ranked = A.importance(df, estimator.fit(M.assemble(df, XS)), XS, 3).orderBy("place").collect()
    assert len(ranked) == 3 and ranked[0].importance > ranked[-1].importance
    assert "d" not in [r.name for r in ranked]
    steps = A.elimination(df, "t", estimator, XS, "value", 3).orderBy(F.desc("n_features")).collect()
    assert [s.n_features for s in steps] == [4, 3, 2, 1] and steps[1].removed == "d"
    assert steps[0].r2 > steps[-1].r2
