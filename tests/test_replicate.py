"""Bootstrap by multiplicities against draws written out one by one."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import replicate as RP

draw = RP.hash_draw(3)


def drawn(n, reps, block):
    """Multiplicities of all replicates, block by block."""
    draws = np.full(reps, n)
    return np.hstack([RP.multiplicities(n, np.arange(reps), draws, at, draw, 5, block) for at in range(-(-n // block))])


@pytest.mark.parametrize(("n", "block"), [(1, 4), (7, 100), (103, 10), (64, 16)])
def test_every_replicate_draws_n_rows(n, block):
    w = drawn(n, 300, block)
    assert w.shape == (300, n) and (w.sum(1) == n).all() and (w >= 0).all()
    assert abs(w.mean(0) - 1).max() < 6 * np.sqrt(1 / 300)


def test_counts_vary_like_a_multinomial():
    for block in (1000, 9):
        w = drawn(50, 4000, block)
        assert np.allclose(w.var(0), 1 - 1 / 50, atol=0.15)
        cross = np.cov(w[:, 0], w[:, 40])[0, 1]
        assert abs(cross + 1 / 50) < 0.06


@pytest.mark.parametrize("block", [1000, 16])
def test_moments_of_the_replicates(spark, block):
    rng = np.random.default_rng(1)
    pdf = pd.concat([pd.DataFrame({"k": k, "i": range(n), "x": rng.normal(1e6, 1, n), "y": rng.normal(size=n)}) for k, n in (("a", 70), ("b", 33))])
    got = RP.moments(spark.createDataFrame(pdf).repartition(5), ["k"], "i", ["x", "y"], 120, draw, 5, block).toPandas()
    assert len(got) == 240
    for k, part in pdf.groupby("k"):
        w, v = drawn(len(part), 120, block), part[["x", "y"]].to_numpy()
        for r in got[got["k"] == k].itertuples():
            sample = np.repeat(v, w[r.rep].astype(int), axis=0)
            assert np.allclose(r.means, sample.mean(0), rtol=1e-12)
            assert np.allclose(r.covs, np.cov(sample.T, bias=True)[np.triu_indices(2)], atol=1e-9)


def test_bands_hold_the_line_and_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(2)
    n = 1300
    pdf = pd.DataFrame({"k": "a", "t": range(n), "u": rng.normal(size=n), "v": rng.normal(size=n)})
    pdf["y"] = 2 + 3 * pdf["u"] - pdf["v"] + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    one, two = (RP.prediction_bands(d, ["k"], "t", ["u", "v"], "y", 400, draw).orderBy("t", "level").toPandas() for d in (df, df.repartition(7)))
    assert np.allclose(one[["ci_lower", "ci_upper"]], two[["ci_lower", "ci_upper"]], atol=1e-9)
    assert len(one) == 3 * n
    x = np.column_stack([np.ones(n), pdf["u"], pdf["v"]])
    fitted = x @ np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0]
    narrow = one[one["level"] == 90]
    assert ((narrow["ci_lower"].to_numpy() < fitted) & (fitted < narrow["ci_upper"].to_numpy())).all()
    by_level = one.assign(w=one["ci_upper"] - one["ci_lower"]).groupby("level")["w"].mean()
    assert by_level[90] < by_level[95] < by_level[99]


@pytest.mark.parametrize(("n", "length", "block"), [(23, 4, 100), (23, 4, 6), (40, 10, 10), (5, 5, 100)])
def test_moving_blocks_cover_n_rows(n, length, block):
    reps = np.arange(50)
    w = np.hstack([RP.covers(n, length, reps, 50, at, draw, 9, block) for at in range(-(-n // block))])
    assert w.shape == (50, n) and (w >= 0).all() and (w.sum(1) == n).all()
    if block >= n:
        places, starts = -(-n // length), n - length + 1
        for rep in reps:
            want = np.zeros(n)
            for place in range(places):
                first = int(draw(np.array([rep]), np.array([place]), np.array([starts]))[0])
                want[first : first + min(length, n - place * length)] += 1
            assert (want == w[rep]).all()


def test_block_welch_in_parts_of_series(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"s": "a", "t": range(200), "g": ["L"] * 100 + ["H"] * 100, "v": np.r_[rng.normal(0, 1, 100), rng.normal(1, 1, 100)]})
    rows = [RP.block_welch(spark.createDataFrame(pdf), ["s"], "g", "L", "H", "t", "v", 300, draw, block=b).first() for b in (4096, 32)]
    for row in rows:
        assert row.ci_lower < row.t_stat < row.ci_upper < 0 and row.p < 0.05
    assert abs(rows[0].t_stat - rows[1].t_stat) < 1.0


def test_series_too_short_give_no_interval(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"], "i": [0], "x": [1.0], "y": [2.0]}))
    assert RP.sen_interval(df, ["k"], "i", "x", "y", 20, draw).count() == 0
    assert RP.trend_band(df, ["k"], "i", "x", "y", 2, 20, draw).count() == 0


def test_every_pair_of_groups_equals_its_own_comparison(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"s": np.repeat(["a", "b"], 150), "t": list(range(150)) * 2, "g": np.tile(np.repeat(["P", "Q", "R"], [40, 70, 40]), 2)})
    pdf["v"] = rng.normal(size=300) + (pdf["g"] == "Q") * 0.5 + np.sin(pdf["t"] / 3)
    df = spark.createDataFrame(pdf)
    got = {(r.s, r.one, r.two): (r.t_stat, r.p) for r in RP.block_welch_pairs(df, ["s"], "g", ["P", "Q", "R"], "t", "v", 60, draw, block=25).collect()}
    assert set(k[1:] for k in got) == {("P", "Q"), ("P", "R"), ("Q", "R")} and len(got) == 6
    alone = {r.s: (r.t_stat, r.p) for r in RP.block_welch(df, ["s"], "g", "P", "R", "t", "v", 60, draw, block=25).collect()}
    assert all(got[s, "P", "R"] == pytest.approx(alone[s], abs=1e-9) for s in "ab")
