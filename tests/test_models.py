"""Regression, causality, change points, spectra and forecasters on series with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import forecasters as N
from tidemark.functions import kernels
from tidemark.operators import changepoint as P
from tidemark.operators import forecast as FC
from tidemark.operators import ml as M
from tidemark.operators import regress as G
from tidemark.operators import resample as RS
from tidemark.operators import spectral as X
from tidemark.operators import univariate as U


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]])
    y = 3 + x @ [1.5, -2.0, 0.0] + 0.1 * rng.normal(size=120)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, s="k", t=range(120))
    return pdf, spark.createDataFrame(pdf)


def test_least_squares_ridge_and_lasso(design):
    pdf, df = design
    x, y = pdf[list("abc")].to_numpy(), pdf["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    row = G.fit(df, ["s"], list("abc"), "y").first()
    assert np.allclose(row["coef"], np.linalg.lstsq(xc, yc, rcond=None)[0]) and row["r2"] > 0.99
    ridge = G.fit(df, ["s"], list("abc"), "y", ridge=5.0).first()
    assert np.allclose(ridge["coef"], np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc))
    b = np.array(G.fit(df, ["s"], list("abc"), "y", lasso=0.3).first()["coef"])
    slope = xc.T @ (yc - xc @ b) / 120
    assert np.all(np.abs(slope) <= 0.3 + 1e-9) and np.allclose(slope[b != 0], 0.3 * np.sign(b[b != 0]))


def test_wide_moments_equal_narrow_ones(design, monkeypatch):
    _, df = design
    narrow = G.moments(df, ["s"], list("abcy")).first()
    monkeypatch.setattr(G, "WIDE", 1)
    wide = G.moments(df, ["s"], list("abcy")).first()
    assert narrow["n"] == wide["n"] and np.allclose(narrow["covs"], wide["covs"]) and np.allclose(narrow["means"], wide["means"])


def test_cross_validation_from_chunks(design):
    pdf, df = design
    got = G.time_series_cv(df, ["s"], "t", list("abc"), "y", 5, ridges=(0.0, 2.0)).toPandas().set_index(["penalty", "fold"])
    size = 120 // 6
    for fold in range(1, 6):
        cut = 120 - (6 - fold) * size
        train, test = pdf[pdf["t"] < cut], pdf[(pdf["t"] >= cut) & (pdf["t"] < cut + size)]
        xm, ym = train[list("abc")].mean().to_numpy(), train["y"].mean()
        xc = train[list("abc")].to_numpy() - xm
        b = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ (train["y"] - ym))
        e = test["y"] - ym - (test[list("abc")].to_numpy() - xm) @ b
        assert got.loc[(2.0, fold), "mse"] == pytest.approx(float((e**2).mean()), rel=1e-8)


def test_granger_direction_and_var(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=400), np.zeros(400)
    for i in range(1, 400):
        y[i] = 0.6 * y[i - 1] + 0.4 * x[i - 1] + 0.3 * rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "t": range(400), "x": x, "y": y}))
    assert G.granger_best(G.granger(df, ["s"], "t", "y", "x", 3), ["s"]).first()["p"] < 1e-6
    assert G.granger(df, ["s"], "t", "x", "y", 1).first()["p"] > 0.01
    step = G.var_forecast(df, ["s"], "t", ["y", "x"], 1, 1).first()
    lag = np.column_stack([np.ones(399), y[:-1], x[:-1]])
    b = np.linalg.lstsq(lag, y[1:], rcond=None)[0]
    assert step["y"] == pytest.approx(b @ [1, y[-1], x[-1]], rel=1e-8)


def test_granger_with_many_lags_matches_direct_regression(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=150), rng.normal(size=150).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "t": range(150), "x": x, "y": y}))
    got = G.granger(df, ["s"], "t", "y", "x", 8).where("lag = 7").first()["f_stat"]
    rows = np.arange(7, 150)
    own = np.column_stack([np.ones(len(rows)), *[y[rows - k] for k in range(1, 8)]])
    full = np.column_stack([own, *[x[rows - k] for k in range(1, 8)]])
    rss = [((y[rows] - m @ np.linalg.lstsq(m, y[rows], rcond=None)[0]) ** 2).sum() for m in (own, full)]
    assert got == pytest.approx((rss[0] - rss[1]) / 7 / (rss[1] / (len(rows) - 15)), rel=1e-6)


def test_rolling_prediction(spark):
    rng = np.random.default_rng(1)
    t = np.arange(70)
    y = 0.3 * t + rng.normal(size=70)
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "t": t, "x": t.astype(float), "y": y}))
    got = G.rolling_prediction(df, ["s"], "t", ["x"], "y", 36).orderBy("t").toPandas()["prediction"]
    assert got[:36].nunique() == 1 and got[0] == pytest.approx(y[:36].mean())
    assert got[50] == pytest.approx(np.polyval(np.polyfit(t[14:50], y[14:50], 1), 50))


def test_change_points(spark):
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(0, 0.3, 60), rng.normal(3, 0.3, 60)])
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "t": range(120), "v": y}))
    split = P.best_split(P.split_scores(df, ["s"], "t", "v"), ["s"], "t")
    window = P.best_split(P.window_scores(df, ["s"], "t", "v"), ["s"], "t")
    assert split.first()["change_index"] == 60 and window.first()["change_index"] == 60
    blocked = P.best_split(P.split_scores(df, ["s"], "t", "v", block=13), ["s"], "t").first()
    assert blocked["change_index"] == 60 and blocked["score"] == pytest.approx(split.first()["score"])
    n = df.groupBy("s").agg(F.count("*").alias("n"))
    assert P.vote([split, window], n, ["s"]).first()["change_index"] == 60
    assert P.vote([split.where("false")], n, ["s"]).first()["change_index"] == 60
    assert P.pelt(df, ["s"], "t", "v", 5.0).first()["breakpoints"] == [60, 120]


def test_wavelet_peaks_at_the_wave_and_stl_adds_up():
    t = np.arange(240)
    power = np.abs(kernels.cwt(np.sin(2 * np.pi * t / 12), np.arange(1, 30), "morl")) ** 2
    assert 0.8125 / (power.mean(axis=1).argmax() + 1) == pytest.approx(1 / 12, rel=0.1)
    y = 0.02 * t + 2 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(0, 0.1, 240)
    for robust in (False, True):
        trend, season, rest = kernels.stl(y, 12, robust=robust)
        assert np.allclose(trend + season + rest, y)
        assert np.corrcoef(season, np.sin(2 * np.pi * t / 12))[0, 1] > 0.99 and np.abs(trend - 0.02 * t)[12:-12].max() < 0.15


def test_spectrum_peaks_and_coherence(spark):
    t = np.arange(120)
    y = np.sin(2 * np.pi * t / 12) + 0.5 * np.sin(2 * np.pi * t / 5)
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "t": t, "y": y, "z": 2 * y}))
    spectrum = X.power_spectrum(df, ["s"], "t", "y", per_year=1.0)
    assert spectrum.agg(F.sum(F.col("power") * F.when(F.col("k").isin(0, 60), 1).otherwise(2))).first()[0] == pytest.approx(120 * (y**2).sum())
    periods = [r["period"] for r in X.peaks(spectrum, ["s"], 0.9).where("power > 1").orderBy("k").collect()]
    assert periods == pytest.approx([12.0, 5.0])
    coh = X.coherence(df, ["s"], "t", "y", "z", longest=32, run_of=2)
    assert coh.where("k = 3").first()["coherence"] == pytest.approx(1.0)


def test_wavelet_coherence_of_a_series_with_itself(spark):
    t = np.arange(100)
    y = np.sin(2 * np.pi * t / 9) + 0.2 * np.random.default_rng(1).normal(size=100)
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "t": t, "x": y, "y": y}))
    coh = X.wavelet_coherence(X.cross_wavelet(df, ["s"], "t", "x", "y", np.arange(2, 18, 1.0)), ["s"], 16)
    assert coh.count() == 1600
    best = X.strongest(coh, ["s"]).first()
    assert best["max_coherence"] == pytest.approx(1.0, abs=1e-6) and abs(best["phase"]) < 1e-9


def test_harmonics_are_recovered(spark):
    t = np.arange(628)
    y = 1.2 * np.cos(2 * np.pi * t / 52.3) - 0.7 * np.sin(2 * np.pi * t / 52.3)
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "t": t, "r": y}))
    table = FC.harmonic_table(FC.harmonic_fit(df, ["s"], "t", "r"), ["s"]).where("period = 52.3").first()
    assert table["amplitude"] == pytest.approx(np.hypot(1.2, 0.7), rel=1e-6)
    assert table["phase"] == pytest.approx(np.arctan2(0.7, 1.2), rel=1e-6)


def test_forecasters():
    rng = np.random.default_rng(3)
    y = np.zeros(600)
    for i in range(1, 600):
        y[i] = 0.7 * y[i - 1] + rng.normal()
    out, _, var = N.arima_forecast(y + 10, 3, (1, 0, 0))
    assert out[0] == pytest.approx(10 + 0.7 * y[-1], abs=0.25) and var == pytest.approx(1.0, abs=0.15)
    t = np.arange(144)
    season, _, _ = N.arima_forecast(5 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 12), 12, (0, 1, 0), (0, 1, 0))
    ahead = np.arange(144, 156)
    assert np.allclose(season, 5 + 0.1 * ahead + 3 * np.sin(2 * np.pi * ahead / 12), atol=1e-6)
    assert N.augmented_dickey_fuller(y)[1] < 0.01 and N.augmented_dickey_fuller(rng.normal(size=300).cumsum())[1] > 0.05
    x = np.linspace(0, 6, 60)[:, None]
    mean, sd = N.gaussian_process(x, np.sin(x[:, 0]), x)
    assert np.abs(mean - np.sin(x[:, 0])).max() < 0.05 and (sd >= 0).all()


def test_quantile_line_against_all_pairs():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=40), rng.normal(size=40)
    for tau in (0.1, 0.5, 0.9):
        loss = lambda b, a: np.where(y - b * x - a >= 0, tau * (y - b * x - a), (tau - 1) * (y - b * x - a)).sum()  # noqa: B023, E731
        lines = [((y[j] - y[i]) / (x[j] - x[i]), i) for i in range(40) for j in range(40) if i != j]
        best = min(loss(s, y[i] - s * x[i]) for s, i in lines)
        b, a = N.quantile_line(x, y, tau)
        assert loss(b, a) == pytest.approx(best, abs=1e-9)


def test_ard_drops_the_idle_feature(design):
    _, df = design
    got = {r["name"]: r["coefficient"] for r in U.ard(df, ["s"], list("abc"), "y").collect()}
    assert got["a"] == pytest.approx(1.5, abs=0.05) and got["b"] == pytest.approx(-2, abs=0.05) and abs(got["c"]) < 0.05


def test_components_of_known_shape(design):
    pdf, df = design
    got = M.principal_components(df, ["s"], list("abc"), 2).where("component = 1").orderBy("name").toPandas()
    values, vectors = np.linalg.eigh(np.corrcoef(pdf[list("abc")].T))
    assert np.allclose(np.abs(got["loading"]), np.abs(vectors[:, -1])) and got["variance_share"][0] == pytest.approx(values[-1] / 3)


def test_bootstrap_is_repeatable_and_covers(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"s": "k", "i": range(40), "x": range(40), "y": 0.5 * np.arange(40) + rng.normal(size=40)}))
    a = RS.sen_interval(df, ["s"], "i", "x", "y", 100, RS.hash_draw(1)).first()
    b = RS.sen_interval(df.repartition(7), ["s"], "i", "x", "y", 100, RS.hash_draw(1)).first()
    # the same draws give the same percentiles; a mean may differ in its last digit with the order of summation
    assert (a["ci_lower"], a["ci_upper"]) == (b["ci_lower"], b["ci_upper"]) and a["mean"] == pytest.approx(b["mean"], rel=1e-12)
    assert a["ci_lower"] < 0.5 < a["ci_upper"]


def test_block_bootstrap_sees_a_shift(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"s": "k", "t": range(80), "g": ["L"] * 40 + ["H"] * 40, "v": np.concatenate([rng.normal(0, 1, 40), rng.normal(3, 1, 40)])})
    row = RS.block_welch(spark.createDataFrame(pdf), ["s"], "g", "L", "H", "t", "v", 200, RS.hash_draw(0)).first()
    assert row["t_stat"] < -4 and row["p"] == 0.0 and row["ci_upper"] < 0


def test_flat_topped_peaks_count_once(spark):
    power = [1.0, 2.0, 9.0, 9.0, 2.0, 1.0, 3.0, 1.0, 4.0, 4.0]
    rows = spark.createDataFrame([("s", k, k / 20, p) for k, p in enumerate(power)], "s string, k long, frequency double, power double")
    found = X.peaks(rows, ["s"], 0.0).orderBy("k")
    assert [r["k"] for r in found.collect()] == [2, 6]
    assert [r["k"] for r in X.dominant_periods(found, ["s"], 4.0, 5).collect()] == [2]


def test_wide_moments_without_keys(spark):
    data = np.random.default_rng(3).normal(size=(60, 14))
    cols = [f"c{i}" for i in range(14)]
    row = G.moments(spark.createDataFrame(pd.DataFrame(data, columns=cols)), [], cols).first()
    assert row["n"] == 60 and np.allclose(row["means"], data.mean(axis=0))
    assert np.allclose(row["covs"], np.cov(data.T, bias=True)[np.triu_indices(14)])


def test_permutation_importance_shuffles_every_row(spark):
    class Sum:
        def transform(self, df):
            return df.withColumn("prediction", F.col("a") + 10 * F.col("b"))

    n = 12_000
    rows = spark.range(n).select(F.col("id").alias("t"), F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    got = {r["name"]: r["importance"] for r in M.permutation_importance(rows, Sum(), ["a", "b"], ["t"]).collect()}
    assert abs(got["a"] / n - 1 / 3) < 0.01 and abs(got["b"] - 5) < 0.2
