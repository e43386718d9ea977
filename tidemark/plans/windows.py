"""Windows over calendar series and over observation series of any length."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import blocked as B
from tidemark.operators import inference as I
from tidemark.operators import series as S
from tidemark.plans.base import JOINED_SQL, LEVELS_SQL, OBS_SQL, RINGS_SQL, joined, levels, observations, query, r, rings, rounded

W = "OVER (PARTITION BY series ORDER BY t)"


@query(
    "lag_features",
    "W1 W10",
    f"WITH {JOINED_SQL} SELECT series, t, value, "
    + ", ".join(f"lag({c}, {k}) {W} AS {c}_lag{k}" for c in ("value", "qty") for k in (1, 2, 3, 12))
    + " FROM joined",
)
def lag_features(spark, sf):
    wide = S.lags(joined(spark, sf), ["series"], "t", ["value", "qty"], (1, 2, 3, 12))
    return wide.select("series", "t", "value", *[f"{c}_lag{k}" for c in ("value", "qty") for k in (1, 2, 3, 12)])


def frame(k):
    return f"OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


@query("rolling_partial", "W2", f"WITH {LEVELS_SQL} SELECT series, t, round(avg(value) {frame(3)}, 7) AS ma3, round(avg(value) {frame(6)}, 7) AS ma6 FROM levels")
def rolling_partial(spark, sf):
    return levels(spark, sf).select("series", "t", *[r(S.rolling_mean("value", ["series"], "t", k, full=False), 7).alias(f"ma{k}") for k in (3, 6)])


@query(
    "rolling_full",
    "W3",
    f"WITH {LEVELS_SQL} SELECT series, t, "
    + ", ".join(f"CASE WHEN count(value) {frame(k)} = {k} THEN round(avg(value) {frame(k)}, 7) END AS ma{k}" for k in (3, 6, 12))
    + " FROM levels",
)
def rolling_full(spark, sf):
    return levels(spark, sf).select("series", "t", *[r(S.rolling_mean("value", ["series"], "t", k, full=True), 7).alias(f"ma{k}") for k in (3, 6, 12)])


@query("first_diff", "W4", f"WITH {LEVELS_SQL} SELECT series, t, value - lag(value) {W} AS diff FROM levels")
def first_diff(spark, sf):
    return levels(spark, sf).select("series", "t", S.diff("value", ["series"], "t").alias("diff"))


@query("anomaly", "W11", f"WITH {LEVELS_SQL} SELECT series, date, round(value - avg(value) OVER (PARTITION BY series, month), 5) AS anomaly FROM levels")
def anomaly(spark, sf):
    return levels(spark, sf).select("series", "date", r(S.anomaly("value", ["series"]), 5).alias("anomaly"))


@query(
    "zscores",
    "W12 W13",
    f"""WITH {LEVELS_SQL} SELECT series, t, round((value - avg(value) OVER p) / stddev_samp(value) OVER p, 6) AS z_sample,
round((value - avg(value) OVER p) / stddev_pop(value) OVER p, 6) AS z_pop FROM levels WINDOW p AS (PARTITION BY series)""",
)
def zscores(spark, sf):
    return levels(spark, sf).select(
        "series", "t", r(S.standardise("value", ["series"], 1)).alias("z_sample"), r(S.standardise("value", ["series"], 0)).alias("z_pop")
    )


@query(
    "composite_index",
    "T32 W12",
    f"""WITH {JOINED_SQL}, z AS (SELECT series, t, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS zv, (qty - avg(qty) OVER p) / stddev_samp(qty) OVER p AS zq,
(price - avg(price) OVER p) / stddev_samp(price) OVER p AS zp, (disc - avg(disc) OVER p) / stddev_samp(disc) OVER p AS zd FROM joined WINDOW p AS (PARTITION BY series))
SELECT series, t, round((zv - zq + zp + zd) / 4.0, 6) AS index FROM z""",
)
def composite_index(spark, sf):
    out = I.composite_index(joined(spark, sf), ["series"], {"value": 1, "qty": -1, "price": 1, "disc": 1})
    return rounded(out.select("series", "t", "index"), "index")


@query(
    "rolling_corr",
    "W8 F9",
    f"""WITH {JOINED_SQL} SELECT series, t, CASE WHEN count(*) OVER w = 24 THEN round(corr(value, qty) OVER w, 6) END AS r24 FROM joined
WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)""",
)
def rolling_corr(spark, sf):
    return joined(spark, sf).select("series", "t", r(S.rolling_corr("value", "qty", ["series"], "t", 12, 11)).alias("r24"))


#: Periods of the pseudo-coherence matrix, in rows.
PERIODS = range(6, 47, 2)


@query(
    "rolling_corr_matrix",
    "F9 W8",
    f"WITH {JOINED_SQL} "
    + " UNION ALL ".join(
        f"""SELECT series, CAST({k} AS BIGINT) AS period, t, round(abs(corr(value, qty) OVER w), 6) AS coherence, count(*) OVER w AS n FROM joined
WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN {k // 2} PRECEDING AND {k // 2 - 1} FOLLOWING)"""
        for k in PERIODS
    ).join(["SELECT series, period, t, coherence FROM (", ") WHERE n = period"]),
)
def rolling_corr_matrix(spark, sf):
    """Pseudo-coherence by period: absolute rolling correlation with a frame of one period."""
    wide = joined(spark, sf).select(
        "series", "t", *[F.abs(S.rolling_corr("value", "qty", ["series"], "t", k // 2, k // 2 - 1)).alias(str(k)) for k in PERIODS]
    )
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("period"), F.col(f"`{k}`").alias("coherence")) for k in PERIODS])
    return wide.select("series", "t", F.inline(rows)).where(F.col("coherence").isNotNull()).withColumn("coherence", r("coherence"))


@query(
    "gradient",
    "W9",
    f"""WITH {LEVELS_SQL} SELECT series, t, round(coalesce((lead(value) {W} - lag(value) {W}) / 2.0, lead(value) {W} - value, value - lag(value) {W}), 6) AS gradient FROM levels""",
)
def gradient(spark, sf):
    return levels(spark, sf).select("series", "t", r(S.gradient("value", ["series"], "t")).alias("gradient"))


@query(
    "average_ranks",
    "W16",
    f"""WITH {LEVELS_SQL} SELECT series, date, rank() OVER (PARTITION BY series ORDER BY n_obs) + (count(*) OVER (PARTITION BY series, n_obs) - 1) / 2.0::DOUBLE AS rank FROM levels""",
)
def average_ranks(spark, sf):
    return levels(spark, sf).select("series", "date", S.average_rank("n_obs", ["series"]).alias("rank"))


@query(
    "split_window_means",
    "W5",
    f"""WITH {LEVELS_SQL} SELECT series, t, round(avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 5) AS mean_before,
round(avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING), 5) AS mean_after FROM levels""",
)
def split_window_means(spark, sf):
    w = S.by(["series"], "t")
    return levels(spark, sf).select(
        "series", "t", r(F.avg("value").over(w.rowsBetween(-24, -1)), 5).alias("mean_before"), r(F.avg("value").over(w.rowsBetween(0, 23)), 5).alias("mean_after")
    )


@query(
    "detrend_deseason",
    "F1 T6",
    f"""WITH {LEVELS_SQL}, d AS (SELECT *, regr_intercept(value, t) OVER (PARTITION BY series) + regr_slope(value, t) OVER (PARTITION BY series) * t AS trend FROM levels),
s AS (SELECT *, avg(value - trend) OVER (PARTITION BY series, month) AS seasonal FROM d)
SELECT series, t, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal, round(value - trend - seasonal, 5) AS residual FROM s""",
)
def detrend_deseason(spark, sf):
    out = S.deseasonalised(levels(spark, sf), ["series"], "t", "value")
    return rounded(out.select("series", "t", "trend", "seasonal", "residual"), "trend", "seasonal", "residual", digits=5)


@query(
    "seasonal_encodings",
    "F12",
    f"""WITH {LEVELS_SQL} SELECT series, t, round(sin(2 * pi() * month / 12.0), 9) AS sin12, round(cos(2 * pi() * month / 12.0), 9) AS cos12,
round(sin(2 * pi() * month / 6.0), 9) AS sin6, round(cos(2 * pi() * month / 6.0), 9) AS cos6 FROM levels""",
)
def seasonal_encodings(spark, sf):
    s12, c12 = C.seasonal_pair("month", 12.0)
    s6, c6 = C.seasonal_pair("month", 6.0)
    out = levels(spark, sf).select("series", "t", s12.alias("sin12"), c12.alias("cos12"), s6.alias("sin6"), c6.alias("cos6"))
    # rounding leaves tiny negatives as -0.0; adding zero makes them plain zeros
    return out.select("series", "t", *[(F.round(c, 9) + 0.0).alias(c) for c in ("sin12", "cos12", "sin6", "cos6")])


@query(
    "cum_arc_length",
    "A22 G1 W14",
    f"""WITH {RINGS_SQL}, d AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq)),
e AS (SELECT ring, seq, CASE WHEN plon IS NULL THEN 0 ELSE 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) END AS step FROM d)
SELECT ring, seq, round(sum(step) OVER (PARTITION BY ring ORDER BY seq), 5) AS arc_km FROM e""",
)
def cum_arc_length(spark, sf):
    from tidemark.operators import geo

    return rounded(geo.arc_length(rings(spark, sf), ["ring"], "seq").select("ring", "seq", "arc_km"), "arc_km", digits=5)


# ------------------------------------------------------------------ observation series


@query("obs_index", "D5 W10", f"WITH {OBS_SQL} SELECT series, event_id, t FROM obs")
def obs_index(spark, sf):
    return observations(spark, sf).select("series", "event_id", "t")


@query(
    "obs_running_sum",
    "A22",
    """SELECT event_type AS series, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events""",
)
def obs_running_sum(spark, sf):
    o = observations(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return B.running_sum(o, ["series"], ["t"], "cents", F.floor(F.col("t") / 500), "running").select("series", "event_id", "running")


@query(
    "obs_rolling",
    "W3 W4 W5",
    f"""WITH {OBS_SQL} SELECT series, t, round(avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS ma24,
round(avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING), 6) AS ahead24, round(value - lag(value) {W}, 6) AS diff FROM obs""",
)
def obs_rolling(spark, sf):
    exprs = {
        "ma24": lambda w: F.avg("value").over(w.rowsBetween(-23, 0)),
        "ahead24": lambda w: F.avg("value").over(w.rowsBetween(0, 23)),
        "diff": lambda w: F.col("value") - F.lag("value").over(w),
    }
    out = B.windowed(observations(spark, sf).select("series", "t", "value"), ["series"], "t", 23, 23, exprs, block=1000)
    return rounded(out.drop("value"), "ma24", "ahead24", "diff")


@query(
    "obs_interp",
    "P15",
    f"WITH {OBS_SQL}, gaps AS (SELECT series, t, CASE WHEN t < 5 OR t % 11 IN (2, 3, 4) OR (t BETWEEN 400 AND 700) THEN NULL ELSE value END AS value FROM obs), "
    + """a AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series ORDER BY t) AS lo,
    min(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM gaps)
SELECT a.series, a.t, round(coalesce(a.value, l.value + (h.value - l.value) * (a.t - a.lo) / (a.hi - a.lo), l.value, h.value), 6) AS value
FROM a LEFT JOIN gaps l ON a.series = l.series AND a.lo = l.t LEFT JOIN gaps h ON a.series = h.series AND a.hi = h.t""",
)
def obs_interp(spark, sf):
    gap = (F.col("t") < 5) | (F.col("t") % 11).isin(2, 3, 4) | F.col("t").between(400, 700)
    o = observations(spark, sf).select("series", "t", F.when(~gap, F.col("value")).alias("value"))
    return rounded(B.interpolate_linear(o, ["series"], "t", "value", block=250), "value")


@query("synthetic_covariates", "S17 S16")
def synthetic_covariates(spark, sf):
    """Stand-in covariates for series that lack one, the same in every run."""
    made = {"t2m": S.synthetic_trend("t", 15.0, 0.02, 2.0, 1, "series", "t"), "tp": S.synthetic_trend("t", 50.0, 0.01, 10.0, 2, "series", "t")}
    return rounded(levels(spark, sf).select("series", "t").withColumns(made), "t2m", "tp")
