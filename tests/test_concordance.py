"""Concordance and Theil-Sen of long series against all pairs."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import concordance as C
from tidemark.operators import trend as T


def pairs(x, y, w=None):
    w = np.ones(len(x)) if w is None else w
    signs = np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :]) * w[:, None] * w[None, :]
    return int(np.triu(signs, 1).sum())


def test_in_memory_sums():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = rng.integers(0, 400)
        x, y, w = rng.integers(0, 30, n), rng.integers(0, 40, n), rng.integers(1, 9, n)
        assert C.concordant(x, y, w) == pairs(x, y, w)
        assert C.concordant(x, y) == pairs(x, y)
        v = rng.permutation(n) if rng.random() < 0.5 else rng.integers(0, 20, n)
        i, j = C.inversions(v)
        assert sorted(zip(i, j)) == [(a, b) for a in range(n) for b in range(a + 1, n) if v[a] > v[b]]


@pytest.fixture(scope="module")
def long(spark):
    """One key holds nine tenths of the rows, one value a third of them."""
    rng = np.random.default_rng(5)
    n = 3000
    k = np.where(rng.random(n) < 0.9, "big", np.where(rng.random(n) < 0.5, "mid", "low"))
    y = np.where(rng.random(n) < 0.33, 7.0, rng.integers(0, 400, n) + np.arange(n) * 0.02)
    pdf = pd.DataFrame({"k": k, "t": np.arange(n), "x": rng.integers(0, 300, n).astype(float), "y": y})
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["one", "flat", "flat"], "t": [0, 0, 1], "x": [1.0, 1.0, 1.0], "y": [2.0, 3.0, 4.0]})])
    return pdf, spark.createDataFrame(pdf).repartition(6)


@pytest.mark.parametrize("sizes", [{}, {"block": 100}, {"block": 16, "fan": 3, "few": 5}])
def test_concordance_in_blocks(long, sizes):
    pdf, df = long
    got = {r.k: r for r in C.concordance(df, ["k"], "x", "y", **sizes).collect()}
    assert set(got) == set(pdf["k"])
    for k, p in pdf.groupby("k"):
        x, y = p["x"].to_numpy(), p["y"].to_numpy()
        assert int(got[k].s) == pairs(x, y) and got[k].n == len(p)
        assert int(got[k].tied_y) == sum(c * (c - 1) // 2 for c in p.groupby("y").size())


def test_kendall_and_mann_kendall_agree_with_short_forms(long):
    pdf, df = long
    tau = {r.k: r.tau_b for r in C.kendall_tau_b(df, ["k"], "x", "y", block=64).collect()}
    short = {r.k: r.tau_b for r in T.kendall_tau_b(df, ["k"], "x", "y").collect()}
    assert tau["big"] == pytest.approx(short["big"], abs=1e-12) and tau["flat"] is None
    a = {r.k: (r.s, r.n, r.var_s, r.z, r.trend) for r in T.mann_kendall_long(df, ["k"], "t", "y", block=128).collect()}
    assert a == {r.k: (r.s, r.n, r.var_s, r.z, r.trend) for r in T.mann_kendall(df, ["k"], "t", "y").collect()}


@pytest.mark.parametrize("sizes", [{}, {"block": 200, "last": 500}])
def test_theil_sen_in_blocks(long, sizes):
    pdf, df = long
    pdf, df = pdf[pdf["k"] != "big"], df.where("k <> 'big'")
    got = {r.k: r.slope for r in C.theil_sen_long(df, ["k"], "x", "y", **sizes).collect()}
    assert set(got) == {"mid", "low", "one", "flat"} and got["one"] is None and got["flat"] is None
    for k in ("mid", "low"):
        p = pdf[pdf["k"] == k]
        assert got[k] == pytest.approx(kernels.theil_sen(p["x"].to_numpy(), p["y"].to_numpy()), rel=1e-12, abs=1e-12)


def test_one_slope_for_all_pairs(spark):
    df = spark.range(400).selectExpr("1 AS k", "id AS t", "2.5 * id + 1 AS y")
    assert C.theil_sen_long(df, ["k"], "t", "y", block=64, last=100).first().slope == pytest.approx(2.5, rel=1e-12)


def test_many_points(spark):
    """A million points take some three minutes; they run with TIDEMARK_LONG set."""
    n = 1_000_000 if os.environ.get("TIDEMARK_LONG") else 60_000
    df = spark.range(n).selectExpr("1 AS k", "id AS t", "0.003 * id + 50 * sin(id * 12.9898) + 20 * cos(id * 78.233)  AS y")
    slope = C.theil_sen_long(df, ["k"], "t", "y").first().slope
    assert abs(slope - 0.003) < 1e-6
    x = np.arange(n)
    y = 0.003 * x + 50 * np.sin(x * 12.9898) + 20 * np.cos(x * 78.233)
    under, over = ((C.concordant(x, y - s * x)) for s in (slope - 1e-11, slope + 1e-11))
    assert over <= 0 <= under


def test_blocks_without_a_slope_that_is_left(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.integers(0, 5000, 400)).astype(float)
    y = 0.01 * x + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"k": "click", "x": x, "y": y}))
    got = C.theil_sen_long(df, ["k"], "x", "y", block=32, last=4).first()
    assert got.k == "click" and got.slope == pytest.approx(kernels.theil_sen(x, y), rel=1e-12)


def test_rounds_leave_no_long_estimates(spark, monkeypatch):
    """Few slopes may be left, so it takes rounds; none lengthens the size that the plans of the next are estimated with."""
    rng = np.random.default_rng(8)
    x = np.sort(rng.integers(0, 3000, 300)).astype(float)
    y = np.round(0.02 * x + 20 * rng.normal(size=300))
    sizes, cut = [], C.cut_lineage

    def seen(df):
        out = cut(df)
        sizes.append(out._jdf.logicalPlan().stats().sizeInBytes())
        return out

    monkeypatch.setattr(C, "cut_lineage", seen)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y}))
    assert C.theil_sen_long(df, ["k"], "x", "y", block=64, last=3).first().slope == pytest.approx(kernels.theil_sen(x, y), rel=1e-9)
    assert max(sizes) < 1 << 63 and len(sizes) < 120


def test_the_sample_leaves_few_slopes(spark):
    rng = np.random.default_rng(6)
    x, y = np.arange(5000.0), rng.normal(size=5000)
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "_x": x, "_y": y, "_rx": np.arange(5000)}))
    n = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    got = C._sampled(rows, n, ["k"]).first()
    i, j = np.triu_indices(5000, 1)
    slopes = (y[j] - y[i]) / (x[j] - x[i])
    assert got._lo < np.median(slopes) < got._hi
    assert ((slopes > got._lo) & (slopes < got._hi)).mean() < 0.2
