"""Spectra, coherence, wavelets and seasonal decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import series as S
from tidemark.operators import spectral as X
from tidemark.plans.base import JOINED_SQL, LEVELS_SQL, OBS_SQL, joined, levels, observations, query, r, rounded

RESID_SQL = """dt AS (SELECT *, value - regr_intercept(value, t) OVER p - regr_slope(value, t) OVER p * t AS d FROM levels WINDOW p AS (PARTITION BY series)),
res AS (SELECT series, t, d - avg(d) OVER (PARTITION BY series, month) AS y FROM dt)"""
DFT_SQL = """nn AS (SELECT series, count(*) AS n FROM res GROUP BY series),
ks AS (SELECT series, n, unnest(range(0, n // 2 + 1)) AS k FROM nn),
sp AS (SELECT ks.series, ks.k, any_value(n) AS n, pow(sum(y * cos(2 * pi() * ks.k * t / n)), 2) + pow(sum(y * sin(2 * pi() * ks.k * t / n)), 2) AS power FROM ks JOIN res ON ks.series = res.series GROUP BY ks.series, ks.k)"""


def residuals(spark, sf):
    return S.deseasonalised(levels(spark, sf), ["series"], "t", "value").select("series", "t", F.col("residual").alias("y"))


@query("dft_power", "F2 F1", f"WITH {LEVELS_SQL}, {RESID_SQL}, {DFT_SQL} SELECT series, k, round(k * 12.0 / n, 9) AS frequency, round(power, 3) AS power FROM sp WHERE k > 0")
def dft_power(spark, sf):
    p = X.power_spectrum(residuals(spark, sf), ["series"], "t", "y").where(F.col("k") > 0)
    return rounded(rounded(p, "frequency", digits=9), "power", digits=3)


@query(
    "spectral_peaks",
    "F3 F2 A20",
    f"""WITH {LEVELS_SQL}, {RESID_SQL}, {DFT_SQL}, w AS (SELECT *, lag(power) OVER o AS a, lead(power) OVER o AS b FROM sp WINDOW o AS (PARTITION BY series ORDER BY k)),
h AS (SELECT series, quantile_cont(power, 0.9) AS h FROM sp GROUP BY series)
SELECT w.series, k, round(k * 12.0 / n, 9) AS frequency, round(n / (k * 12.0), 7) AS period, round(power, 3) AS power FROM w JOIN h USING (series) WHERE power > a AND power > b AND power >= h""",
)
def spectral_peaks(spark, sf):
    p = X.peaks(X.power_spectrum(residuals(spark, sf), ["series"], "t", "y"), ["series"], 0.9)
    return rounded(rounded(rounded(p, "frequency", digits=9), "period", digits=7), "power", digits=3)


@query(
    "spectral_peaks_five",
    "F3 A20",
    f"""WITH {LEVELS_SQL}, {RESID_SQL}, {DFT_SQL}, w AS (SELECT *, lag(power) OVER o AS a, lead(power) OVER o AS b FROM sp WINDOW o AS (PARTITION BY series ORDER BY k)),
h AS (SELECT series, quantile_cont(power, 0.75) AS h FROM sp GROUP BY series),
p AS (SELECT w.series, k, k * 12.0 / n AS frequency, n / (k * 12.0) AS period, power FROM w JOIN h USING (series) WHERE power > a AND power > b AND power >= h AND n / CAST(k AS DOUBLE) > 2)
SELECT series, k, round(frequency, 9) AS frequency, round(period, 7) AS period, round(power, 3) AS power, place FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY k) - 1 AS place FROM p) WHERE place < 5""",
)
def spectral_peaks_five(spark, sf):
    """The first five peaks above the upper quartile of the power whose period exceeds two months."""
    found = X.peaks(X.power_spectrum(residuals(spark, sf), ["series"], "t", "y"), ["series"], 0.75)
    p = X.dominant_periods(found, ["series"], 2 / 12, 5)
    return rounded(rounded(rounded(p, "frequency", digits=9), "period", digits=7), "power", digits=3)


def welch_sql(src: str, longest: int) -> str:
    return f"""le AS (SELECT series, count(*) AS n, least({longest}, count(*) // 4) AS len FROM {src} GROUP BY series),
st AS (SELECT *, len - len // 2 AS step, (n - len // 2) // (len - len // 2) AS cnt FROM le),
sg AS (SELECT series, len, step, unnest(range(0, cnt)) AS seg FROM st),
ro AS (SELECT s.series, seg, len, r.t - seg * step AS j, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y FROM sg s JOIN {src} r ON r.series = s.series AND r.t >= seg * step AND r.t < seg * step + len WINDOW g AS (PARTITION BY s.series, seg)),
wi AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / len) AS w FROM ro),
kk AS (SELECT series, unnest(range(0, len // 2 + 1)) AS k FROM st),
ft AS (SELECT wi.series, seg, k, any_value(len) AS len, sum(w * x * cos(2 * pi() * k * j / len)) AS xr, -sum(w * x * sin(2 * pi() * k * j / len)) AS xi, sum(w * y * cos(2 * pi() * k * j / len)) AS yr, -sum(w * y * sin(2 * pi() * k * j / len)) AS yi
  FROM wi JOIN kk USING (series) GROUP BY wi.series, seg, k),
cs AS (SELECT series, k, any_value(len) AS len, avg(xr * xr + xi * xi) AS xx, avg(yr * yr + yi * yi) AS yy, avg(xr * yr + xi * yi) AS re, avg(xr * yi - xi * yr) AS im FROM ft GROUP BY series, k)"""


@query(
    "spectral_coherence",
    "F4",
    f"""WITH {JOINED_SQL}, sr AS (SELECT series, t, value AS x, qty AS y FROM joined), {welch_sql('sr', 128)}
SELECT series, k, round(CAST(k AS DOUBLE) / len, 9) AS frequency, round((re * re + im * im) / (xx * yy), 6) AS coherence FROM cs WHERE k > 0""",
)
def spectral_coherence(spark, sf):
    c = X.coherence(joined(spark, sf), ["series"], "t", "value", "qty").where(F.col("k") > 0)
    return rounded(rounded(c, "frequency", digits=9), "coherence")


@query(
    "spectral_coherence_obs",
    "F4 D5",
    f"""WITH {OBS_SQL}, sr AS (SELECT series, t, value AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM obs), {welch_sql('sr', 64)}
SELECT series, k, round(CAST(k AS DOUBLE) / len, 9) AS frequency, round((re * re + im * im) / (xx * yy), 6) AS coherence FROM cs WHERE k > 0""",
)
def spectral_coherence_obs(spark, sf):
    o = observations(spark, sf).withColumn("other", (F.col("event_id") % 97).cast("double"))
    c = X.coherence(o, ["series"], "t", "value", "other", longest=64, run_of=8).where(F.col("k") > 0)
    return rounded(rounded(c, "frequency", digits=9), "coherence")


@query(
    "coherence_ranking",
    "F4 A25 A19",
    f"""WITH {JOINED_SQL}, sr AS (SELECT series, t, value AS x, qty AS y FROM joined), {welch_sql('sr', 128)}, co AS (SELECT series, k, CAST(k AS DOUBLE) / len AS f, (re * re + im * im) / (xx * yy) AS c FROM cs WHERE k > 0)
SELECT series, round(max(c), 6) AS max_coherence, round(avg(c), 6) AS mean_coherence, round(1 / arg_max(f, c), 6) AS period_max FROM co GROUP BY series""",
)
def coherence_ranking(spark, sf):
    c = X.coherence(joined(spark, sf), ["series"], "t", "value", "qty").where(F.col("k") > 0)
    return rounded(X.coherence_ranking(c, ["series"]), "max_coherence", "mean_coherence", "period_max")


WAVELET_STEP = float(kernels.mother_wavelet("morl")[0][1] - kernels.mother_wavelet("morl")[0][0])
WAVELET_SQL = f"""ps AS (SELECT i, sum(exp(-x * x / 2) * cos(5 * x)) OVER (ORDER BY i) * {WAVELET_STEP!r} AS v FROM (SELECT i, -8 + 16.0 * i / 1023 AS x FROM (SELECT unnest(range(0, 1024)) AS i))),
sl AS (SELECT s, unnest(range(0, 16 * s + 1)) AS k FROM (SELECT unnest(range(1, 20)) AS s)),
ka AS (SELECT s, k, CAST(floor(k::DOUBLE / (s * {WAVELET_STEP!r}::DOUBLE)) AS BIGINT) AS j FROM sl),
kb AS (SELECT s, k, v, count(*) OVER (PARTITION BY s) AS len FROM ka JOIN ps ON ps.i = ka.j WHERE j < 1024),
kc AS (SELECT s, len, len - 1 - k AS p, v FROM kb UNION ALL SELECT DISTINCT s, len, len, 0.0 FROM kb),
kd AS (SELECT s, len, p, v - coalesce(lag(v) OVER (PARTITION BY s ORDER BY p), 0) AS d FROM kc),
co AS (SELECT a.series, s, a.t, -sqrt(s) * sum(b.y * d) AS c FROM res a JOIN res b ON a.series = b.series JOIN kd ON p = a.t + (len - 2) // 2 + 1 - b.t GROUP BY a.series, s, a.t)"""


@query(
    "wavelet_power",
    "F5 A19",
    f"WITH {LEVELS_SQL}, {RESID_SQL}, {WAVELET_SQL} SELECT series, CAST(s AS DOUBLE) AS scale, round(s / 0.8125::DOUBLE, 4) AS period, round(avg(c * c), 4) AS global_power FROM co GROUP BY series, s",
)
def wavelet_power(spark, sf):
    p = X.wavelet_power(residuals(spark, sf), ["series"], "t", "y", range(1, 20))
    return rounded(X.global_power(p, ["series"]), "global_power", "period", digits=4)


@query("wavelet_dominant_scale", "F5 A19")
def wavelet_dominant_scale(spark, sf):
    p = X.wavelet_power(residuals(spark, sf), ["series"], "t", "y", range(1, 30))
    return rounded(X.dominant_scale(X.global_power(p, ["series"]), ["series"]), "period", "global_power", digits=4)


WTC_SCALES = [1 + i / 2 for i in range(64)]


@query("wavelet_coherence", "F6 F7 F8")
def wavelet_coherence(spark, sf):
    scaled = joined(spark, sf).select("series", "t", S.standardise("value", ["series"], 0).alias("x"), S.standardise("qty", ["series"], 0).alias("y"))
    coh = X.wavelet_coherence(X.cross_wavelet(scaled, ["series"], "t", "x", "y", WTC_SCALES), ["series"], len(WTC_SCALES))
    mean = coh.groupBy("series", "i").agg(F.avg("coherence").alias("coherence"), F.first("period").alias("period"))
    return rounded(mean, "coherence", "period", digits=5)


@query("wavelet_phase_lag", "F6 F7 F8 A26")
def wavelet_phase_lag(spark, sf):
    scaled = joined(spark, sf).select("series", "t", S.standardise("value", ["series"], 0).alias("x"), S.standardise("qty", ["series"], 0).alias("y"))
    coh = X.wavelet_coherence(X.cross_wavelet(scaled, ["series"], "t", "x", "y", WTC_SCALES), ["series"], len(WTC_SCALES))
    return rounded(X.strongest(coh, ["series"]), "max_coherence", "period", "phase", "lag", digits=5)


@query("stl_decomposition", "F10")
def stl_decomposition(spark, sf):
    return rounded(X.stl(levels(spark, sf), ["series"], "t", "value"), "trend", "seasonal", "remainder", digits=4)


@query("stl_robust", "F10")
def stl_robust(spark, sf):
    return rounded(X.stl(levels(spark, sf), ["series"], "t", "value", robust=True), "trend", "seasonal", "remainder", digits=4)
