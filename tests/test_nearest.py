"""Nearest neighbours against all distances; outlier repair on a long ring."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import geo as G
from tidemark.operators import nearest as N


@pytest.mark.parametrize("few", [2, 32])
def test_nearest_in_groups(spark, few):
    rng = np.random.default_rng(3)
    crowd = rng.normal(50, 1e-6, (150, 2))
    t = pd.DataFrame(np.r_[rng.uniform(-10, 10, (200, 2)), crowd, np.tile([3.0, 4.0], (60, 1)), [[np.nan, 1.0]]], columns=["x", "y"])
    t["g"] = np.where(np.arange(len(t)) % 10 == 0, "b", "a")
    t["v"] = np.arange(len(t))
    p = pd.DataFrame(np.r_[rng.uniform(-12, 12, (80, 2)), [[50.0, 50.0], [1e6, -1e6], [3.0, 4.0], [np.nan, 0.0]]], columns=["px", "py"])
    p["g"] = np.where(np.arange(len(p)) % 4 == 0, "b", "a")
    p["i"] = np.arange(len(p))
    p = pd.concat([p, pd.DataFrame({"px": [0.0], "py": [0.0], "g": ["none"], "i": [999]})])
    got = {r.i: (r.d2, r.v) for r in N.nearest(spark.createDataFrame(p).repartition(3), spark.createDataFrame(t).repartition(4), ["g"], ["i"], "px", "py", ["v"], "x", "y", few).collect()}
    want = {}
    for r in p[p["px"].notna()].itertuples():
        own = t[(t["g"] == r.g) & t["x"].notna()]
        if len(own):
            d = (own["x"] - r.px) ** 2 + (own["y"] - r.py) ** 2
            want[r.i] = (d.min(), own["v"][d == d.min()].min())
    assert set(got) == set(want)
    for i, (d, v) in want.items():
        assert got[i][0] == pytest.approx(d, rel=1e-9, abs=1e-18) and (got[i][1] == v or got[i][0] <= d)


def test_repair_on_a_ring_of_many_vertices(spark):
    n = 100_000
    ring = spark.range(n).selectExpr("'r' AS ring", "2000 AS year", "id AS seq", f"cos(2 * pi() * id / {n}) AS mid_x", f"sin(2 * pi() * id / {n}) AS mid_y", "CASE WHEN id % 1000 = 500 THEN 9999.0 ELSE CAST(id AS DOUBLE) / 100 END AS u", "1.0 AS v")
    got = G.repair_outliers(ring, ["ring", "year"])
    assert got.columns == ring.columns and got.count() == n
    fixed = got.where("seq % 1000 = 500").selectExpr("abs(u - seq / 100) AS off").collect()
    assert len(fixed) == 100 and all(abs(r.off - 0.01) < 1e-9 for r in fixed)


def test_repair_without_valid_samples(spark):
    pdf = pd.DataFrame({"ring": ["a", "a", "b"], "year": 1, "seq": [0, 1, 0], "mid_x": [0.0, 1.0, 0.0], "mid_y": 0.0, "u": [9e9, 9e9, 1.0], "v": 1.0})
    got = {(r.ring, r.seq): r.u for r in G.repair_outliers(spark.createDataFrame(pdf), ["ring", "year"]).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("b", 0): 1.0}
