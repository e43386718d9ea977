"""Distributions, rank statistics, tests and multiple-testing control against known values and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import kernels, special
from tidemark.operators import inference as I
from tidemark.operators import trend as T


def test_distributions():
    assert special.t_two_sided([2.228138852], [10])[0] == pytest.approx(0.05, abs=1e-9)
    assert special.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_quantile(0.975, 5) == pytest.approx(2.570581836, abs=1e-8)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-10)


def test_erfc_column(spark):
    xs = [-5.0, -1.2, -0.3, 0.0, 0.2, 0.46875, 0.5, 1.0, 3.9, 4.1, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(C.erfc("x")).toPandas().iloc[:, 0]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.erfc(x), rel=1e-13, abs=1e-300)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=700))
def test_sign_before_matches_pairs(values):
    v = np.array(values, float)
    assert kernels.sign_before(v).tolist() == [np.sign(v[i] - v[:i]).sum() for i in range(len(v))]
    assert kernels.sign_before(v[::-1]).sum() == -kernels.sign_before(v).sum()


def test_theil_sen_narrows_to_the_same_median():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 60, 300).astype(float), rng.normal(size=300)
    i, j = np.triu_indices(300, 1)
    keep = x[i] != x[j]
    want = np.median((y[j] - y[i])[keep] / (x[j] - x[i])[keep])
    assert kernels.theil_sen(x, y) == pytest.approx(want, abs=1e-12)
    assert kernels.theil_sen(x, y, chunk_pairs=3000) == pytest.approx(want, abs=1e-12)


def test_mann_kendall_known_cases(frame):
    df = frame("k string, t long, v double", ["up"] * 6 + ["tie"] * 4 + ["flat"] * 3, [*range(6), *range(4), *range(3)], [float(v) for v in (1, 2, 3, 4, 5, 6, 1, 1, 2, 3, 7, 7, 7)])
    got = {r["k"]: r for r in T.mann_kendall(df, ["k"], "t", "v").collect()}
    assert got["up"]["tau"] == 1.0 and got["up"]["s"] == 15 and got["up"]["trend"] == "increasing"
    assert got["tie"]["var_s"] == pytest.approx((4 * 3 * 13 - 2 * 1 * 9) / 18)
    assert got["flat"]["z"] is None and got["flat"]["s"] == 0


def test_pettitt_finds_a_step(frame):
    df = frame("s string, t long, v double", ["x"] * 30, range(30), [0.0] * 12 + [1.0] * 18)
    row = T.pettitt(df, ["s"], "t", "v").first()
    assert row["change_index"] == 11 and row["k"] == 12 * 18
    assert T.pettitt_sequential(df, ["s"], "t", "v").first()["change_index"] == 29


def test_kendall_tau_b(frame):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 80).astype(float), rng.integers(0, 9, 80).astype(float)
    i, j = np.triu_indices(80, 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    want = (a * b).sum() / math.sqrt((a != 0).sum() * (b != 0).sum())
    got = T.kendall_tau_b(frame("s string, x double, y double", ["k"] * 80, x.tolist(), y.tolist()), ["s"], "x", "y").first()["tau_b"]
    assert got == pytest.approx(want)


def test_mann_whitney_exact_and_normal(frame):
    a, b = [1.1, 2.2, 3.3, 9.9], [4.4, 5.5, 6.6, 7.7, 8.8]
    df = frame("s string, g string, v double", ["x"] * 9, ["A"] * 4 + ["B"] * 5, a + b)
    row = I.mann_whitney(df, ["s"], "g", "A", "B", "v").first()
    assert row["u_stat"] == sum(p > q for p in a for q in b)
    from itertools import combinations

    us = [sum(p > q for p in c for q in set(range(9)) - set(c)) for c in combinations(range(9), 4)]
    top = max(row["u_stat"], 20 - row["u_stat"])
    assert row["u_p"] == pytest.approx(min(1.0, 2 * np.mean([u >= top for u in us])))
    same = frame("s string, g string, v double", ["x"] * 40, ["A"] * 20 + ["B"] * 20, [1.0, 2.0] * 20)
    assert I.mann_whitney(same, ["s"], "g", "A", "B", "v").first()["u_p"] == pytest.approx(1.0)


def test_benjamini_hochberg(frame):
    df = frame("s string, p double", ["f"] * 4, [0.01, 0.04, 0.03, 0.005])
    got = {round(r["p"], 3): r["p_adjusted"] for r in I.benjamini_hochberg(df, ["s"], "p").collect()}
    assert got == pytest.approx({0.01: 0.02, 0.04: 0.04, 0.03: 0.04, 0.005: 0.02})


def test_extremes_variants(frame):
    df = frame("s string, v double", ["x"] * 11, [float(i) for i in range(11)])
    strict = I.extreme_counts(df, ["s"], "v").first()
    loose = I.extreme_counts(df, ["s"], "v", inclusive=True).first()
    assert (strict["n_high"], strict["n_low"], loose["n_high"], loose["n_low"]) == (1, 1, 2, 2)


def test_partial_correlation_removes_the_shared_driver(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=400)
    pdf = pd.DataFrame({"s": "x", "y": z + 0.3 * rng.normal(size=400), "x": z + 0.3 * rng.normal(size=400), "z": z})
    row = I.partial_correlation(spark.createDataFrame(pdf), ["s"], "y", ["x", "z"]).where(F.col("name") == "x").first()
    ry, rx = (np.polyval(np.polyfit(pdf["z"], pdf[c], 1), pdf["z"]) for c in "yx")
    assert row["r"] == pytest.approx(np.corrcoef(pdf["y"] - ry, pdf["x"] - rx)[0, 1], abs=1e-9)


def test_pacf_by_regression(spark):
    rng = np.random.default_rng(2)
    y = np.zeros(500)
    for i in range(1, 500):
        y[i] = 0.6 * y[i - 1] + rng.normal()
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(y)], "s string, t long, v double")
    pacf = I.partial_autocorrelation(I.autocorrelation(df, ["s"], "t", "v", 4), ["s"]).orderBy("lag").toPandas()["pacf"]
    assert pacf[1] == pytest.approx(0.6, abs=0.1) and abs(pacf[3]) < 0.15


def test_hash_noise_is_normal_and_repeatable(spark):
    from tidemark.operators import series as S

    a = spark.range(20000).repartition(3).select("id", S.hash_normal(5, "id").alias("z")).orderBy("id").toPandas()["z"]
    b = spark.range(20000).repartition(7).select("id", S.hash_normal(5, "id").alias("z")).orderBy("id").toPandas()["z"]
    assert (a == b).all() and abs(a.mean()) < 0.03 and abs(a.std() - 1) < 0.03 and abs((a > 1.96).mean() - 0.025) < 0.005


@pytest.mark.parametrize("block", [65_536, 7])
def test_adjustment_of_a_family_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    p = np.r_[rng.uniform(size=60) ** 2, [0.3] * 9, [1.0, 0.0]]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(p)), "p": p})).repartition(5).unionByName(spark.createDataFrame([(99, None)], "i long, p double"))
    got = {r.i: r.p_adjusted for r in I.benjamini_hochberg_family(df, "p", block=block).collect()}
    order = np.argsort(p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    assert got.pop(99) is None and [got[i] for i in range(len(p))] == pytest.approx(want.tolist())


def test_correlation_with_a_constant_series_is_null(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": range(6), "y": [1.0, 1, 1, 1, 1, 1], "x": [1.0, 2, 3, 4, 5, 6]}))
    assert [r.r for r in I.lagged_correlation(df, ["k"], "t", "y", "x", [1, 2]).collect()] == [None, None]
