"""Block-wise operators against plain computation, with one series holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocked as B
from tidemark.operators import trend as T


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    s = np.array(["hot"] * 700 + ["a"] * 90 + ["b"] * 10)
    v = np.where(rng.random(800) < 0.4, 5.0, np.round(rng.normal(5, 3, 800), 1))
    pdf = pd.DataFrame({"s": s, "ts": rng.permutation(800), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def with_positions(pdf):
    return pdf.sort_values(["s", "ts"]).assign(t=lambda d: d.groupby("s").cumcount())


def test_row_index(skewed):
    pdf, df = skewed
    got = B.row_index(df, ["s"], ["ts"], F.floor(F.col("ts") / 37)).toPandas().sort_values(["s", "ts"])
    assert got["t"].tolist() == with_positions(pdf)["t"].tolist()


def test_running_sum_and_windows(skewed, spark):
    pdf, _ = skewed
    want = with_positions(pdf)
    df = spark.createDataFrame(want)
    got = B.running_sum(df, ["s"], ["t"], "v", F.floor(F.col("t") / 16), "run").toPandas().sort_values(["s", "t"])
    assert np.allclose(got["run"], want.groupby("s")["v"].cumsum())
    rolled = B.windowed(df, ["s"], "t", 4, 2, {"m": lambda w: F.avg("v").over(w.rowsBetween(-4, 2)), "l": lambda w: F.lag("v", 3).over(w)}, block=7)
    rolled = rolled.toPandas().sort_values(["s", "t"])
    assert len(rolled) == len(want)
    for _, part in want.groupby("s"):
        mine = rolled[rolled["s"] == part["s"].iloc[0]]
        v = part["v"].to_numpy()
        assert np.allclose(mine["m"], [v[max(0, i - 4) : i + 3].mean() for i in range(len(v))])
        assert np.allclose(mine["l"].to_numpy()[3:], v[:-3])


def test_interpolation_crosses_blocks(spark):
    v = [None] * 5 + [1.0] + [None] * 40 + [42.0, None, 44.0] + [None] * 9
    df = spark.createDataFrame([("x", i, x) for i, x in enumerate(v)], "s string, t long, v double")
    got = B.interpolate_linear(df, ["s"], "t", "v", block=8).orderBy("t").toPandas()["v"]
    want = pd.Series(v, dtype=float).interpolate(limit_direction="both")
    assert np.allclose(got, want)


@pytest.mark.parametrize("parts", [2, 16])
def test_exact_quantiles(skewed, parts):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = B.exact_quantiles(df, ["s"], "v", probs, parts).toPandas().set_index(["s", "prob"])["quantile"]
    for s, part in pdf.groupby("s"):
        for p in probs:
            assert got[s, p] == pytest.approx(np.percentile(part["v"], 100 * p), abs=1e-9)


def test_sign_sums_of_long_series(skewed, spark):
    pdf, _ = skewed
    want = with_positions(pdf)
    got = T.sign_before_long(spark.createDataFrame(want), ["s"], "t", "v", block=50, parts=8).toPandas().sort_values(["s", "t"])
    brute = np.concatenate([[np.sign(v[i] - v[:i]).sum() for i in range(len(v))] for v in (p["v"].to_numpy() for _, p in want.groupby("s"))])
    assert got["sign_before"].tolist() == brute.tolist()
