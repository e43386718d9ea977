"""Regression, change points, validation, resampling, causality and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import causal as K
from tidemark.operators import changepoint as P
from tidemark.operators import forecast as FC
from tidemark.operators import inference as I
from tidemark.operators import regress as G
from tidemark.operators import relational as R
from tidemark.operators import replicate as RP
from tidemark.operators import resample as RS
from tidemark.operators import series as S
from tidemark.operators import trend as T
from tidemark.plans.base import JOINED_SQL, LEVELS_SQL, OBS_SQL, joined, joined_once, levels, levels_once, observations, query, r, rounded
from tidemark.plans.trend import integral

# ------------------------------------------------------------------ SQL forms of small regressions


def cov(a: str, b: str, over: str = "") -> str:
    return f"covar_pop({a}, {b}) {over}"


def cramer2(s11, s12, s22, s1y, s2y):
    det = f"({s11} * {s22} - {s12} * {s12})"
    return f"(({s1y} * {s22} - {s2y} * {s12}) / {det})", f"(({s2y} * {s11} - {s1y} * {s12}) / {det})"


def cramer3(a, b, c, d, e, f, p, q, s):
    """Solve the symmetric system ((a,b,c),(b,d,e),(c,e,f)) x = (p,q,s)."""
    det = f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {e} - {d} * {c}))"
    x = f"(({p} * ({d} * {f} - {e} * {e}) - {b} * ({q} * {f} - {e} * {s}) + {c} * ({q} * {e} - {d} * {s})) / {det})"
    y = f"(({a} * ({q} * {f} - {e} * {s}) - {p} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {s} - {q} * {c})) / {det})"
    z = f"(({a} * ({d} * {s} - {q} * {e}) - {b} * ({b} * {s} - {q} * {c}) + {p} * ({b} * {e} - {d} * {c})) / {det})"
    return x, y, z


def ols3_sql(source: str, keys: str, x1: str, x2: str, x3: str, y: str) -> str:
    """CTEs ``<source>_m`` and ``<source>_fit`` with b1, b2, b3, b0, n, r2 per key."""
    bs = cramer3("a", "b", "c", "d", "e", "f", "p", "q", "s")
    m = f"""{source}_m AS (SELECT {keys}, count(*) AS n, {cov(x1, x1)} AS a, {cov(x1, x2)} AS b, {cov(x1, x3)} AS c, {cov(x2, x2)} AS d, {cov(x2, x3)} AS e, {cov(x3, x3)} AS f,
  {cov(x1, y)} AS p, {cov(x2, y)} AS q, {cov(x3, y)} AS s, {cov(y, y)} AS yy, avg({x1}) AS m1, avg({x2}) AS m2, avg({x3}) AS m3, avg({y}) AS my FROM {source} GROUP BY {keys})"""
    fit = f"""{source}_b AS (SELECT *, {bs[0]} AS b1, {bs[1]} AS b2, {bs[2]} AS b3 FROM {source}_m),
{source}_fit AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, (b1 * p + b2 * q + b3 * s) / yy AS r2 FROM {source}_b)"""
    return m + ",\n" + fit


# ------------------------------------------------------------------ change points

SPLIT_SQL = """w AS (SELECT series, t, avg(value) OVER a AS m1, var_pop(value) OVER a AS v1, count(value) OVER a AS n1, avg(value) OVER b AS m2, var_pop(value) OVER b AS v2, count(value) OVER b AS n2
  FROM {src} WINDOW a AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
sc AS (SELECT series, t, (m1 - m2) * (m1 - m2) / (((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS score FROM w WHERE t >= 10 AND n2 > 10)"""
WINDOW_SQL = """wd AS (SELECT series, t, abs(avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) - avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) AS score,
  count(*) OVER (PARTITION BY series) AS n FROM {src})"""


@query("cp_split_score", "B1 W6", f"WITH {LEVELS_SQL}, {SPLIT_SQL.format(src='levels')} SELECT series, t, round(score, 7) AS score FROM sc")
def cp_split_score(spark, sf):
    return rounded(P.split_scores(levels(spark, sf), ["series"], "t", "value"), "score", digits=7)


@query(
    "cp_split_obs",
    "B1 D5",
    f"WITH {OBS_SQL}, {SPLIT_SQL.format(src='obs')}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, t) AS rn FROM sc) SELECT series, t AS change_index, round(score, 7) AS score FROM k WHERE rn = 1",
)
def cp_split_obs(spark, sf):
    scores = P.split_scores(observations(spark, sf), ["series"], "t", "value", block=500)
    return rounded(P.best_split(scores, ["series"], "t"), "score", digits=7)


@query(
    "cp_window",
    "B2 W5 A19",
    f"WITH {LEVELS_SQL}, {WINDOW_SQL.format(src='levels')}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, t) AS rn FROM wd WHERE t >= 24 AND t < n - 24) SELECT series, t AS change_index, round(score, 6) AS score FROM k WHERE rn = 1",
)
def cp_window(spark, sf):
    return rounded(P.best_split(P.window_scores(levels(spark, sf), ["series"], "t", "value"), ["series"], "t"), "score")


@query(
    "cp_window_obs",
    "B2 D5",
    f"WITH {OBS_SQL}, {WINDOW_SQL.format(src='obs')}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, t) AS rn FROM wd WHERE t >= 24 AND t < n - 24) SELECT series, t AS change_index, round(score, 6) AS score FROM k WHERE rn = 1",
)
def cp_window_obs(spark, sf):
    return rounded(P.best_split(P.window_scores(observations(spark, sf), ["series"], "t", "value", block=1000), ["series"], "t"), "score")


VOTE_SQL = f"""{SPLIT_SQL.format(src='levels')}, {WINDOW_SQL.format(src='levels')},
v AS (SELECT series, t FROM (SELECT series, t, row_number() OVER (PARTITION BY series ORDER BY score DESC, t) AS rn FROM sc) WHERE rn = 1
  UNION ALL SELECT series, t FROM (SELECT series, t, row_number() OVER (PARTITION BY series ORDER BY score DESC, t) AS rn FROM wd WHERE t >= 24 AND t < n - 24) WHERE rn = 1),
cp AS (SELECT series, CAST(floor(median(t)) AS BIGINT) AS change_index FROM v GROUP BY series)"""


def change_vote(base):
    a = P.best_split(P.split_scores(base, ["series"], "t", "value"), ["series"], "t")
    b = P.best_split(P.window_scores(base, ["series"], "t", "value"), ["series"], "t")
    lengths = base.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    return P.vote([a, b], lengths, ["series"])


@query("cp_vote", "B4", f"WITH {LEVELS_SQL}, {VOTE_SQL} SELECT * FROM cp")
def cp_vote(spark, sf):
    return change_vote(levels_once(spark, sf))


SEG_SQL = f"""{VOTE_SQL},
seg AS (SELECT l.series, l.t, l.date, l.value, CASE WHEN l.t < cp.change_index THEN 'pre' ELSE 'post' END AS segment, CAST(l.t AS DOUBLE) / count(*) OVER (PARTITION BY l.series) AS tn,
  sin(month * (2 * pi() / 12.0)) AS sn, cos(month * (2 * pi() / 12.0)) AS cs FROM levels l JOIN cp ON l.series = cp.series),
{ols3_sql('seg', 'series, segment', 'tn', 'sn', 'cs', 'value')}"""


@query(
    "segmented_fit",
    "B5 F12 M1",
    f"WITH {LEVELS_SQL}, {SEG_SQL} SELECT series, segment, n, round(b1, 4) AS trend, round(b2, 5) AS sin, round(b3, 5) AS cos, round(b0, 4) AS intercept, round(r2, 7) AS r2 FROM seg_fit",
)
def segmented_fit(spark, sf):
    base = levels_once(spark, sf)
    m = P.segmented_fit(base, ["series"], "t", "value", change_vote(base))
    return m.select(
        "series", "segment", "n", r(F.col("coef")[0], 4).alias("trend"), r(F.col("coef")[1], 5).alias("sin"), r(F.col("coef")[2], 5).alias("cos"), r("intercept", 4).alias("intercept"), r("r2", 7).alias("r2")
    )


@query(
    "tvp_rolling",
    "W7 B6",
    f"""WITH {LEVELS_SQL}, f AS (SELECT *, CAST(t AS DOUBLE) / 100.0 AS tn, sin(month * (2 * pi() / 12.0)) AS sn, cos(month * (2 * pi() / 12.0)) AS cs FROM levels),
m AS (SELECT series, t, tn, sn, cs, value, {', '.join(f'covar_pop({x}, {y}) OVER w AS {n}' for n, x, y in (('a', 'tn', 'tn'), ('b', 'tn', 'sn'), ('c', 'tn', 'cs'), ('d', 'sn', 'sn'), ('e', 'sn', 'cs'), ('f', 'cs', 'cs'), ('p', 'tn', 'value'), ('q', 'sn', 'value'), ('s', 'cs', 'value')))},
  avg(tn) OVER w AS m1, avg(sn) OVER w AS m2, avg(cs) OVER w AS m3, avg(value) OVER w AS my, avg(CASE WHEN t < 36 THEN value END) OVER (PARTITION BY series) AS start
  FROM f WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, {cramer3('a', 'b', 'c', 'd', 'e', 'f', 'p', 'q', 's')[0]} AS b1, {cramer3('a', 'b', 'c', 'd', 'e', 'f', 'p', 'q', 's')[1]} AS b2, {cramer3('a', 'b', 'c', 'd', 'e', 'f', 'p', 'q', 's')[2]} AS b3 FROM m)
SELECT series, t, round(CASE WHEN t < 36 THEN start ELSE my + b1 * (tn - m1) + b2 * (sn - m2) + b3 * (cs - m3) END, 4) AS prediction FROM b""",
)
def tvp_rolling(spark, sf):
    rows = levels(spark, sf).withColumns(P.season_features("t", F.lit(100.0)))
    return rounded(G.rolling_prediction(rows, ["series"], "t", P.FEATURES, "value", 36).select("series", "t", "prediction"), "prediction", digits=4)


@query(
    "model_leaderboard",
    "B6 T31 A25",
    f"""WITH {LEVELS_SQL}, {SEG_SQL},
base AS (SELECT series, value, value - regr_intercept(value, t) OVER p - regr_slope(value, t) OVER p * t AS e FROM levels WINDOW p AS (PARTITION BY series)),
segp AS (SELECT s.series, s.value, s.value - (f.b0 + f.b1 * s.tn + f.b2 * s.sn + f.b3 * s.cs) AS e FROM seg s JOIN seg_fit f USING (series, segment)),
allm AS (SELECT 'trend' AS model, series, value, e FROM base UNION ALL SELECT 'segmented', series, value, e FROM segp),
g AS (SELECT series, model, 1 - sum(e * e) / regr_syy(value, value) AS r2, sqrt(avg(e * e)) AS rmse FROM allm GROUP BY ALL)
SELECT series, model, 'in_sample' AS eval_split, round(r2, 6) AS r2, round(rmse, 5) AS rmse, rank() OVER (PARTITION BY series ORDER BY r2 DESC) AS place FROM g""",
)
def model_leaderboard(spark, sf):
    base = levels_once(spark, sf)
    change = change_vote(base)
    seg = P.segmented_fit(base, ["series"], "t", "value", change)
    rows = base.join(base.groupBy("series").agg(F.count(F.lit(1)).alias("_n")), "series").join(change, "series").withColumns(P.season_features("t", F.col("_n")))
    rows = rows.withColumn("segment", F.when(F.col("t") < F.col("change_index"), "pre").otherwise("post"))
    segmented = G.predict(rows, seg, ["series", "segment"], P.FEATURES).select(F.lit("segmented").alias("model"), "series", "value", "prediction")
    line = S.detrended(base, ["series"], "t", "value").select(F.lit("trend").alias("model"), "series", "value", F.col("trend").alias("prediction"))
    scores = I.metrics(segmented.unionByName(line), ["series", "model"], "value", "prediction").select("series", "model", F.lit("in_sample").alias("eval_split"), "r2", "rmse")
    place = F.rank().over(S.by(["series"], "r2_neg")).cast("long")
    ranked = scores.withColumn("r2_neg", -F.col("r2")).withColumn("place", place).drop("r2_neg")
    return rounded(rounded(ranked, "r2"), "rmse", digits=5)


# ------------------------------------------------------------------ regression

XS = ("qty", "price", "disc")


@query(
    "multiple_ols",
    "M1 M33 D15 D16",
    f"WITH {JOINED_SQL}, {ols3_sql('joined', 'series', *XS, 'value')} SELECT series, n, round(b1, 5) AS qty, round(b2, 5) AS price, round(b3, 5) AS disc, round(b0, 3) AS intercept, round(r2, 7) AS r2 FROM joined_fit",
)
def multiple_ols(spark, sf):
    m = G.fit(joined(spark, sf), ["series"], XS, "value")
    return m.select("series", "n", *[r(F.col("coef")[i], 5).alias(x) for i, x in enumerate(XS)], r("intercept", 3).alias("intercept"), r("r2", 7).alias("r2"))


@query(
    "ridge_fit",
    "M3",
    f"""WITH {JOINED_SQL}, {ols3_sql('joined', 'series', *XS, 'value')},
g AS (SELECT *, a + 10.0 / n AS a2, d + 10.0 / n AS d2, f + 10.0 / n AS f2 FROM joined_m),
h AS (SELECT *, {cramer3('a2', 'b', 'c', 'd2', 'e', 'f2', 'p', 'q', 's')[0]} AS b1, {cramer3('a2', 'b', 'c', 'd2', 'e', 'f2', 'p', 'q', 's')[1]} AS b2, {cramer3('a2', 'b', 'c', 'd2', 'e', 'f2', 'p', 'q', 's')[2]} AS b3 FROM g)
SELECT series, round(b1, 5) AS qty, round(b2, 5) AS price, round(b3, 5) AS disc, round(my - b1 * m1 - b2 * m2 - b3 * m3, 3) AS intercept FROM h""",
)
def ridge_fit(spark, sf):
    m = G.fit(joined(spark, sf), ["series"], XS, "value", ridge=10.0)
    return m.select("series", *[r(F.col("coef")[i], 5).alias(x) for i, x in enumerate(XS)], r("intercept", 3).alias("intercept"))


@query("lasso_fit", "M5 C9")
def lasso_fit(spark, sf):
    m = G.fit(joined(spark, sf), ["series"], XS, "value", lasso=0.5)
    return rounded(G.coefficients(m, ["series"], XS), "coefficient", digits=5)


@query(
    "lasso_single",
    "M5",
    f"""WITH {LEVELS_SQL} SELECT series, 't' AS name, round(sign(covar_pop(value, t)) * greatest(abs(covar_pop(value, t)) - 20.0, 0) / var_pop(t), 6) + 0 AS coefficient FROM levels GROUP BY series""",
)
def lasso_single(spark, sf):
    m = G.fit(levels(spark, sf), ["series"], ["t"], "value", lasso=20.0)
    return rounded(G.coefficients(m, ["series"], ["t"]), "coefficient").withColumn("coefficient", F.col("coefficient") + 0.0)


FOLD_SQL = """n AS (SELECT series, count(*) AS n, count(*) // 6 AS size FROM {src} GROUP BY series)"""


@query(
    "ts_split_folds",
    "M15",
    f"""WITH {LEVELS_SQL}, {FOLD_SQL.format(src='levels')} SELECT series, k AS fold, n - (6 - k) * size AS train_rows, n - (6 - k) * size AS test_start, n - (5 - k) * size AS test_end
FROM n, (SELECT unnest(range(1, 6)) AS k)""",
)
def ts_split_folds(spark, sf):
    return G.fold_bounds(levels(spark, sf), ["series"], 5)


@query(
    "time_series_cv",
    "M4 M15 T31",
    f"""WITH {LEVELS_SQL}, {FOLD_SQL.format(src='levels')}, fo AS (SELECT series, k AS fold, n - (6 - k) * size AS cut, size FROM n, (SELECT unnest(range(1, 6)) AS k)),
pen AS (SELECT unnest([0.0::DOUBLE, 100.0::DOUBLE, 10000.0::DOUBLE]) AS penalty),
tr AS (SELECT l.series, fold, penalty, covar_pop(value, t) / (var_pop(t) + any_value(penalty) / count(*)) AS b, avg(value) AS my, avg(t) AS mt FROM levels l JOIN fo ON l.series = fo.series AND l.t < fo.cut CROSS JOIN pen GROUP BY l.series, fold, penalty)
SELECT l.series, penalty, fo.fold, count(*) AS n_test, round(avg(pow(value - my - b * (t - mt), 2)), 4) AS mse, round(1 - avg(pow(value - my - b * (t - mt), 2)) / var_pop(value), 6) AS r2
FROM levels l JOIN fo ON l.series = fo.series AND l.t >= fo.cut AND l.t < fo.cut + fo.size JOIN tr ON tr.series = fo.series AND tr.fold = fo.fold GROUP BY l.series, penalty, fo.fold""",
)
def time_series_cv(spark, sf):
    cv = G.time_series_cv(levels(spark, sf), ["series"], "t", ["t"], "value", 5, ridges=(0.0, 100.0, 10000.0))
    return rounded(rounded(cv, "mse", digits=4), "r2")


@query("ridge_cv", "M4 M3")
def ridge_cv(spark, sf):
    """Fifty penalties by five folds from one pass over the rows."""
    grid = [10 ** (-3 + 6 * i / 49) for i in range(50)]
    cv = G.time_series_cv(joined_once(spark, sf), ["series"], "t", list(XS), "value", 5, ridges=grid)
    return rounded(rounded(G.best_penalty(cv, ["series"]), "penalty", digits=8), "mse", digits=4)


@query(
    "forward_selection",
    "M8",
    f"""WITH {JOINED_SQL}, c AS (SELECT series, {', '.join(f'corr(value, {x}) AS r_{x}' for x in XS)}, {', '.join(f'corr({a}, {b}) AS {a}_{b}' for a in XS for b in XS if a != b)} FROM joined GROUP BY series),
one AS (SELECT series, x AS name, rr AS r2 FROM (SELECT series, 'qty' AS x, r_qty * r_qty AS rr FROM c UNION ALL SELECT series, 'price', r_price * r_price FROM c UNION ALL SELECT series, 'disc', r_disc * r_disc FROM c)
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY rr DESC) = 1),
two AS (SELECT series, name, r2, prev FROM ({' UNION ALL '.join(f"SELECT c.series, '{b}' AS name, (r_{a} * r_{a} + r_{b} * r_{b} - 2 * r_{a} * r_{b} * {a}_{b}) / (1 - {a}_{b} * {a}_{b}) AS r2, one.r2 AS prev FROM c JOIN one ON one.series = c.series AND one.name = '{a}'" for a in XS for b in XS if a != b)})
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY r2 DESC) = 1),
three AS (SELECT c.series, x.name, two.r2 AS prev, two.prev AS first,
  (r_qty * r_qty * (1 - price_disc * price_disc) + r_price * r_price * (1 - qty_disc * qty_disc) + r_disc * r_disc * (1 - qty_price * qty_price)
   - 2 * r_qty * r_price * (qty_price - qty_disc * price_disc) - 2 * r_qty * r_disc * (qty_disc - qty_price * price_disc) - 2 * r_price * r_disc * (price_disc - qty_price * qty_disc))
  / (1 + 2 * qty_price * qty_disc * price_disc - qty_price * qty_price - qty_disc * qty_disc - price_disc * price_disc) AS r2
  FROM c JOIN one ON one.series = c.series JOIN two ON two.series = c.series JOIN (SELECT unnest(['qty', 'price', 'disc']) AS name) x ON x.name <> one.name AND x.name <> two.name)
SELECT series, 1::BIGINT AS step, name, round(r2, 7) AS r2 FROM one WHERE r2 >= 0.005 UNION ALL SELECT series, 2, name, round(r2, 7) FROM two WHERE r2 - prev >= 0.005 AND prev >= 0.005
UNION ALL SELECT series, 3, name, round(r2, 7) FROM three WHERE r2 - prev >= 0.005 AND prev - first >= 0.005 AND first >= 0.005""",
)
def forward_selection(spark, sf):
    return rounded(G.forward_selection(joined(spark, sf), ["series"], XS, "value"), "r2", digits=7)


@query(
    "temporal_split_eval",
    "M16 M34 T31",
    f"""WITH {LEVELS_SQL}, f AS (SELECT series, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM levels WHERE year <= 1999 GROUP BY series)
SELECT l.series, CASE WHEN year <= 1999 THEN 'train' ELSE 'test' END AS eval_split, round(1 - sum(pow(value - a - b * t, 2)) / regr_syy(value, value), 6) AS r2, round(sqrt(avg(pow(value - a - b * t, 2))), 5) AS rmse, count(*) AS n
FROM levels l JOIN f USING (series) GROUP BY ALL""",
)
def temporal_split_eval(spark, sf):
    base = levels_once(spark, sf)
    split = F.when(F.col("year") <= 1999, "train").otherwise("test")
    model = G.fit(base.where(F.col("year") <= 1999), ["series"], ["t"], "value")
    scored = G.predict(base.withColumn("eval_split", split), model, ["series"], ["t"])
    m = I.metrics(scored, ["series", "eval_split"], "value", "prediction").select("series", "eval_split", "r2", "rmse", "n")
    return rounded(rounded(m, "r2"), "rmse", digits=5)


# ------------------------------------------------------------------ causality


@query(
    "granger_lag1",
    "C1 C2",
    f"""WITH {JOINED_SQL}, l AS (SELECT series, value AS y, lag(value) OVER w AS y1, lag(qty) OVER w AS x1 FROM joined WINDOW w AS (PARTITION BY series ORDER BY t)),
c AS (SELECT series, count(*) AS n, var_pop(y) AS yy, var_pop(y1) AS a, covar_pop(y1, x1) AS b, var_pop(x1) AS d, covar_pop(y1, y) AS p, covar_pop(x1, y) AS q FROM l WHERE y1 IS NOT NULL GROUP BY series),
s AS (SELECT *, {cramer2('a', 'b', 'd', 'p', 'q')[0]} AS b1, {cramer2('a', 'b', 'd', 'p', 'q')[1]} AS b2 FROM c),
f AS (SELECT series, CAST(n - 3 AS DOUBLE) AS dof, ((yy - p * p / a) - (yy - b1 * p - b2 * q)) / ((yy - b1 * p - b2 * q) / (n - 3)) AS f_stat FROM s)
SELECT series, 1::BIGINT AS lag, round(f_stat, 5) AS f_stat, round(abs(1 - 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * {integral('pow(1 + {x} * {x} / dof, -(dof + 1) / 2)', 'sqrt(greatest(f_stat, 0))')}), 6) AS p FROM f""",
)
def granger_lag1(spark, sf):
    return rounded(rounded(G.granger(joined(spark, sf), ["series"], "t", "value", "qty", 1), "f_stat", digits=5), "p")


@query("granger_best_lag", "C1 C2")
def granger_best_lag(spark, sf):
    return rounded(G.granger_best(G.granger(joined(spark, sf), ["series"], "t", "value", "qty", 4), ["series"]), "p")


@query("granger_twelve_lags", "C1")
def granger_twelve_lags(spark, sf):
    return rounded(rounded(G.granger(joined_once(spark, sf), ["series"], "t", "value", "qty", 12), "f_stat", digits=4), "p", digits=5)


@query(
    "liang_kleeman",
    "C4 W9",
    f"""WITH {JOINED_SQL}, g AS (SELECT series, qty AS x, value AS y, coalesce((lead(qty) OVER w - lag(qty) OVER w) / 2.0, lead(qty) OVER w - qty, qty - lag(qty) OVER w) AS dx,
  coalesce((lead(value) OVER w - lag(value) OVER w) / 2.0, lead(value) OVER w - value, value - lag(value) OVER w) AS dy FROM joined WINDOW w AS (PARTITION BY series ORDER BY t))
SELECT series, round(covar_samp(x, y) / var_pop(x) * (covar_samp(x, dx) - covar_samp(y, dy)), 5) AS flow FROM g GROUP BY series""",
)
def liang_kleeman(spark, sf):
    return rounded(K.information_flow(joined(spark, sf), ["series"], "t", "qty", "value"), "flow", digits=5)


@query(
    "impact_ols",
    "C5",
    f"""WITH {LEVELS_SQL}, {VOTE_SQL}, f AS (SELECT l.series, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM levels l JOIN cp USING (series) WHERE t < change_index GROUP BY l.series)
SELECT l.series, t, value AS actual, round(a + b * t, 5) AS expected, round(value - a - b * t, 5) AS impact FROM levels l JOIN cp USING (series) JOIN f USING (series) WHERE t >= change_index""",
)
def impact_ols(spark, sf):
    base = levels_once(spark, sf)
    return rounded(K.impact(base, ["series"], "t", "value", change_vote(base)), "expected", "impact", digits=5)


@query(
    "counterfactual",
    "C6 S16",
    f"""WITH {LEVELS_SQL}, {SEG_SQL}, e AS (SELECT series, max(t) AS lt, max(date) AS ld, count(*) AS n, arg_max(value, t) AS optimistic FROM levels GROUP BY series),
h AS (SELECT *, CAST(ld + to_months(CAST(k AS INTEGER)) AS DATE) AS date, CAST(lt + k AS DOUBLE) / n AS tn FROM e, (SELECT unnest(range(1, 61)) AS k)),
p AS (SELECT h.series, h.date, h.optimistic, f.segment, f.b0 + f.b1 * h.tn + f.b2 * sin(month(h.date) * (2 * pi() / 12.0)) + f.b3 * cos(month(h.date) * (2 * pi() / 12.0)) AS y FROM h JOIN seg_fit f ON f.series = h.series)
SELECT series, date, round(max(CASE WHEN segment = 'post' THEN y END), 3) AS pessimistic, round(avg(y), 3) AS probable, any_value(optimistic) AS optimistic FROM p GROUP BY series, date""",
)
def counterfactual(spark, sf):
    base = levels_once(spark, sf)
    return rounded(K.counterfactual(base, ["series"], "t", "value", change_vote(base), 60), "pessimistic", "probable", digits=3)


@query("permutation_causality", "C3")
def permutation_causality(spark, sf):
    scaled = joined_once(spark, sf).select("series", "t", S.standardise("qty", ["series"], 0).alias("x"), S.standardise("value", ["series"], 0).alias("y"))
    return rounded(K.permutation_causality(scaled, ["series"], "t", "x", "y", lag=2, eps=1.0, reps=100), "observed", "p")


@query("var_forecast", "C7")
def var_forecast(spark, sf):
    return rounded(G.var_forecast(joined_once(spark, sf), ["series"], "t", ["value", "qty"], 2, 5), "value", "qty", digits=4)


@query(
    "var_differences",
    "C7 W4",
    f"""WITH {JOINED_SQL}, d AS (SELECT series, t, value AS level, value - lag(value) OVER w AS a, qty - lag(qty) OVER w AS b, qty AS qlevel FROM joined WINDOW w AS (PARTITION BY series ORDER BY t)),
l AS (SELECT *, lag(a) OVER w AS a1, lag(b) OVER w AS b1 FROM d WINDOW w AS (PARTITION BY series ORDER BY t)),
c AS (SELECT series, var_pop(a1) AS s11, covar_pop(a1, b1) AS s12, var_pop(b1) AS s22, covar_pop(a1, a) AS s1a, covar_pop(b1, a) AS s2a, covar_pop(a1, b) AS s1b, covar_pop(b1, b) AS s2b, avg(a1) AS ma1, avg(b1) AS mb1, avg(a) AS ma, avg(b) AS mb FROM l WHERE a1 IS NOT NULL GROUP BY series),
k AS (SELECT *, {cramer2('s11', 's12', 's22', 's1a', 's2a')[0]} AS ca1, {cramer2('s11', 's12', 's22', 's1a', 's2a')[1]} AS ca2, {cramer2('s11', 's12', 's22', 's1b', 's2b')[0]} AS cb1, {cramer2('s11', 's12', 's22', 's1b', 's2b')[1]} AS cb2 FROM c),
e AS (SELECT series, arg_max(a, t) AS la, arg_max(b, t) AS lb, arg_max(level, t) AS ll, arg_max(qlevel, t) AS lq FROM d GROUP BY series),
f AS (SELECT k.*, e.ll, e.lq, ma + ca1 * (la - ma1) + ca2 * (lb - mb1) AS fa, mb + cb1 * (la - ma1) + cb2 * (lb - mb1) AS fb FROM k JOIN e USING (series)),
g AS (SELECT *, ma + ca1 * (fa - ma1) + ca2 * (fb - mb1) AS ga, mb + cb1 * (fa - ma1) + cb2 * (fb - mb1) AS gb FROM f)
SELECT series, 1::BIGINT AS step, round(ll + fa, 4) AS value, round(lq + fb, 4) AS qty FROM g UNION ALL SELECT series, 2, round(ll + fa + ga, 4), round(lq + fb + gb, 4) FROM g""",
)
def var_differences(spark, sf):
    return rounded(G.var_forecast(joined_once(spark, sf), ["series"], "t", ["value", "qty"], 1, 2, differenced=True), "value", "qty", digits=4)


# ------------------------------------------------------------------ forecasting


@query(
    "scaled_seasonal_forecast",
    "M26 S16",
    f"""WITH {LEVELS_SQL}, rc AS (SELECT * FROM levels WHERE year BETWEEN 1996 AND 2000), an AS (SELECT series, year, avg(value) AS v FROM rc GROUP BY ALL),
f AS (SELECT series, regr_slope(v, year) AS b, regr_intercept(v, year) AS a FROM an GROUP BY series),
pa AS (SELECT series, month, avg(value) AS m FROM rc WHERE year = 2000 GROUP BY ALL), pm AS (SELECT series, avg(m) AS mm, count(*) AS k FROM pa GROUP BY series),
gr AS (SELECT f.*, mm, k, y, mo FROM f JOIN pm USING (series), (SELECT unnest(range(2001, 2006)) AS y), (SELECT unnest(range(1, 13)) AS mo))
SELECT gr.series, y AS year, mo AS month, round((a + b * y) * (CASE WHEN k = 12 THEN m / mm ELSE 1 END), 4) AS forecast FROM gr LEFT JOIN pa ON pa.series = gr.series AND pa.month = mo""",
)
def scaled_seasonal_forecast(spark, sf):
    known = levels_once(spark, sf).where(F.col("year") <= 2000)
    return rounded(FC.scaled_seasonal(known, ["series"], "value", 1996, 2001, 2005), "forecast", digits=4)


@query(
    "scaled_seasonal_ahead",
    "M26 S16",
    f"""WITH {LEVELS_SQL}, en AS (SELECT series, max(year) AS e FROM levels GROUP BY series), rc AS (SELECT l.*, year - e AS y0 FROM levels l JOIN en USING (series) WHERE year > e - 5), an AS (SELECT series, y0, avg(value) AS v FROM rc GROUP BY ALL),
f AS (SELECT series, regr_slope(v, y0) AS b, regr_intercept(v, y0) AS a FROM an GROUP BY series),
pa AS (SELECT series, month, avg(value) AS m FROM rc WHERE y0 = 0 GROUP BY ALL), pm AS (SELECT series, avg(m) AS mm, count(*) AS k FROM pa GROUP BY series),
gr AS (SELECT f.*, mm, k, y, mo, e FROM f JOIN pm USING (series) JOIN en USING (series), (SELECT unnest(range(1, 6)) AS y), (SELECT unnest(range(1, 13)) AS mo))
SELECT gr.series, e + y AS year, mo AS month, round((a + b * y) * (CASE WHEN k = 12 THEN m / mm ELSE 1 END), 4) AS forecast FROM gr LEFT JOIN pa ON pa.series = gr.series AND pa.month = mo""",
)
def scaled_seasonal_ahead(spark, sf):
    """Five years ahead of each series' own last year; an incomplete last year gives a flat pattern."""
    return rounded(FC.scaled_seasonal_ahead(levels_once(spark, sf), ["series"], "value"), "forecast", digits=4)


@query(
    "endpoint_trend",
    "M27 A27",
    f"""WITH {LEVELS_SQL}, a AS (SELECT series, year, avg(value) AS v FROM levels GROUP BY ALL), g AS (SELECT series, arg_max(v, year) AS last, arg_min(v, year) FILTER (year >= 1998) AS first, count(*) FILTER (year >= 1998) AS n FROM a GROUP BY series)
SELECT series, k AS step, round(last + (last - first) / (n - 1) * k, 5) AS forecast FROM g, (SELECT unnest(range(1, 6)) AS k)""",
)
def endpoint_trend(spark, sf):
    annual = R.annual_mean(levels(spark, sf), "value", ["series"])
    return rounded(FC.endpoint_trend(annual, ["series"], "year", "value", F.col("year") >= 1998, 5), "forecast", digits=5)


@query(
    "shrink_to_mean",
    "M28 M35",
    f"""WITH {JOINED_SQL}, g AS (SELECT series, arg_max(qty, t) AS lq, avg(qty) AS mq, arg_max(price, t) AS lp, avg(price) AS mp FROM joined GROUP BY series)
SELECT series, k AS step, round(mq + pow(0.99, k - 1) * (lq - mq), 6) AS qty, round(mp + pow(0.99, k - 1) * (lp - mp), 6) AS price FROM g, (SELECT unnest(range(1, 6)) AS k)""",
)
def shrink_to_mean(spark, sf):
    return rounded(FC.shrink_to_mean(joined(spark, sf), ["series"], "t", ["qty", "price"], 5), "qty", "price")


@query(
    "calibrate_splice",
    "M30 A23",
    f"""WITH {JOINED_SQL}, px AS (SELECT series, year, avg(qty) AS x FROM joined GROUP BY ALL), ob AS (SELECT series, year, avg(value) AS x FROM joined WHERE year >= 1997 GROUP BY ALL),
f AS (SELECT px.series, regr_slope(ob.x, px.x) AS b, regr_intercept(ob.x, px.x) AS a FROM px JOIN ob USING (series, year) WHERE px.year <= 2001 GROUP BY px.series)
SELECT px.series, px.year, round(a + b * x, 4) AS value, 'proxy' AS source FROM px JOIN f USING (series) WHERE year < 1997 UNION ALL SELECT series, year, round(x, 4), 'observed' FROM ob""",
)
def calibrate_splice(spark, sf):
    j = joined_once(spark, sf)
    proxy = j.groupBy("series", "year").agg(F.avg("qty").alias("x"))
    observed = j.groupBy("series", "year").agg(F.avg("value").alias("x"))
    return rounded(FC.calibrate_splice(proxy, observed, ["series"], 1997, 2001), "value", digits=4)


SCENARIOS = {
    "Baseline": {},
    "qty_+10%": {"qty": ("*", 1.1)},
    "qty_-10%": {"qty": ("*", 0.9)},
    "price_+20%": {"price": ("*", 1.2)},
    "price_-20%": {"price": ("*", 0.8)},
    "disc_+2": {"disc": ("+", 2.0)},
    "disc_-2": {"disc": ("+", -2.0)},
}


def scenario_case(feature: str, scenarios: dict = SCENARIOS) -> str:
    arms = " ".join(f"WHEN scenario = '{s}' THEN {feature} {c[feature][0]} CAST({c[feature][1]} AS DOUBLE)" for s, c in scenarios.items() if feature in c)
    return f"CASE {arms} ELSE {feature} END"


@query(
    "scenario_grid",
    "M32 J9 D17",
    f"""WITH {JOINED_SQL}, {ols3_sql('joined', 'series', *XS, 'value')}, sc AS (SELECT unnest([{', '.join(f"'{s}'" for s in SCENARIOS)}]) AS scenario),
p AS (SELECT j.series, scenario, b0 + b1 * {scenario_case('qty')} + b2 * {scenario_case('price')} + b3 * {scenario_case('disc')} AS y FROM joined j JOIN joined_fit USING (series) CROSS JOIN sc),
g AS (SELECT series, scenario, avg(y) AS m, stddev_pop(y) AS s FROM p GROUP BY ALL), bl AS (SELECT series, m AS base FROM g WHERE scenario = 'Baseline')
SELECT series, scenario, round(m, 3) AS mean_level, round(s, 3) AS std_level, round(100 * (m - base) / base, 4) + 0 AS change_pct FROM g JOIN bl USING (series)""",
)
def scenario_grid(spark, sf):
    j = joined_once(spark, sf)
    model = G.fit(j, ["series"], XS, "value")
    rows = FC.scenario_rows(j.select("series", *XS), XS, SCENARIOS)
    out = FC.scenario_summary(G.predict(rows, model, ["series"], XS), ["series"], "prediction", "Baseline")
    return rounded(rounded(out, "mean_level", "std_level", digits=3), "change_pct", digits=4).withColumn("change_pct", F.col("change_pct") + 0.0)


# The baseline, two shares up and down, one shift up and down, and one more share up and down.
NINE_SCENARIOS = SCENARIOS | {"disc_+20%": {"disc": ("*", 1.2)}, "disc_-20%": {"disc": ("*", 0.8)}}


@query(
    "scenario_grid_nine",
    "M32 J9 D17",
    f"""WITH {JOINED_SQL}, {ols3_sql('joined', 'series', *XS, 'value')}, sc AS (SELECT unnest([{', '.join(f"'{s}'" for s in NINE_SCENARIOS)}]) AS scenario),
p AS (SELECT j.series, scenario, b0 + b1 * {scenario_case('qty', NINE_SCENARIOS)} + b2 * {scenario_case('price', NINE_SCENARIOS)} + b3 * {scenario_case('disc', NINE_SCENARIOS)} AS y FROM joined j JOIN joined_fit USING (series) CROSS JOIN sc),
g AS (SELECT series, scenario, avg(y) AS m, stddev_pop(y) AS s FROM p GROUP BY ALL), bl AS (SELECT series, m AS base FROM g WHERE scenario = 'Baseline')
SELECT series, scenario, round(m, 3) AS mean_level, round(s, 3) AS std_level, round(100 * (m - base) / base, 4) + 0 AS change_pct FROM g JOIN bl USING (series)""",
)
def scenario_grid_nine(spark, sf):
    j = joined_once(spark, sf)
    rows = FC.scenario_rows(j.select("series", *XS), XS, NINE_SCENARIOS)
    out = FC.scenario_summary(G.predict(rows, G.fit(j, ["series"], XS, "value"), ["series"], XS), ["series"], "prediction", "Baseline")
    return rounded(rounded(out, "mean_level", "std_level", digits=3), "change_pct", digits=4).withColumn("change_pct", F.col("change_pct") + 0.0)


@query(
    "sensitivity",
    "M31",
    f"""WITH {JOINED_SQL}, {ols3_sql('joined', 'series', *XS, 'value')}, st AS (SELECT series, stddev_pop(value) AS sd, avg(abs(qty)) AS aq, avg(abs(price)) AS ap, avg(abs(disc)) AS ad FROM joined GROUP BY series),
pc AS (SELECT unnest([-20, -10, 10, 20]) AS pct)
SELECT series, name, CAST(pct AS BIGINT) AS change_pct, round(v * abs(pct) / 100.0, 5) AS sensitivity FROM (
  SELECT series, 'qty' AS name, abs(b1) * aq / sd AS v FROM joined_fit JOIN st USING (series) UNION ALL SELECT series, 'price', abs(b2) * ap / sd FROM joined_fit JOIN st USING (series) UNION ALL SELECT series, 'disc', abs(b3) * ad / sd FROM joined_fit JOIN st USING (series)), pc""",
)
def sensitivity(spark, sf):
    j = joined_once(spark, sf)
    return rounded(FC.sensitivity(j, G.fit(j, ["series"], XS, "value"), ["series"], XS, "value"), "sensitivity", digits=5)


@query(
    "harmonic_fit",
    "F11",
    f"""WITH {LEVELS_SQL}, d AS (SELECT series, t, month, value - regr_intercept(value, t) OVER p - regr_slope(value, t) OVER p * t AS d FROM levels WINDOW p AS (PARTITION BY series)),
e AS (SELECT series, t, d - avg(d) OVER (PARTITION BY series, month) AS y, cos(t * (2 * pi() / 8.7)) AS c, sin(t * (2 * pi() / 8.7)) AS s FROM d),
g AS (SELECT series, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(c * y) AS cy, sum(s * y) AS sy FROM e GROUP BY series),
h AS (SELECT series, {cramer2('cc', 'cs', 'ss', 'cy', 'sy')[0]} AS a, {cramer2('cc', 'cs', 'ss', 'cy', 'sy')[1]} AS b FROM g)
SELECT series, 8.7::DOUBLE AS period, round(sqrt(a * a + b * b), 5) AS amplitude, round(atan2(-b, a), 5) AS phase FROM h""",
)
def harmonic_fit(spark, sf):
    parts = S.deseasonalised(levels_once(spark, sf), ["series"], "t", "value")
    model = FC.harmonic_fit(parts, ["series"], "t", "residual", (8.7,))
    return rounded(FC.harmonic_table(model, ["series"], (8.7,)), "amplitude", "phase", digits=5)


@query("harmonic_forecast", "M29 F11 A13")
def harmonic_forecast(spark, sf):
    return rounded(FC.harmonic_forecast(levels_once(spark, sf), ["series"], "t", "value", 60), "forecast", digits=3)


# ------------------------------------------------------------------ resampling

# An integer mix gives draws that SQL can repeat; the operators default to a hash.
LCG_SQL = "((rep * 7919 + place * 104729 + rep * place * 31 + 17) * 2654435761 % 4294967296 // 65536) % n"


def lcg(rep, place, n):
    mixed = (rep * 7919 + place * 104729 + rep * place * 31 + 17) * F.lit(2654435761) % F.lit(4294967296)
    return F.shiftright(mixed, 16) % n


def lcg_picks(rep, place, n):
    """:func:`lcg` on arrays."""
    mixed = (rep * 7919 + place * 104729 + rep * place * 31 + 17).astype("uint64") * 2654435761 % 4294967296
    return (mixed >> 16).astype("int64") % n


def annual_indexed(spark, sf):
    annual = R.annual_mean(levels(spark, sf), "value", ["series"])
    return S.with_index(annual, ["series"], "year", "i")


ANNUAL_SQL = "an AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM (SELECT series, year, avg(value) AS value FROM levels GROUP BY ALL))"
DRAW_SQL = f"dr AS (SELECT series, rep, {LCG_SQL} AS i FROM (SELECT DISTINCT series, n FROM an) CROSS JOIN (SELECT unnest(range(0, 200)) AS rep) CROSS JOIN (SELECT unnest(range(0, 7)) AS place) WHERE place < n)"


@query(
    "bootstrap_trend_band",
    "T19 T18",
    f"""WITH {LEVELS_SQL}, {ANNUAL_SQL}, {DRAW_SQL}, fi AS (SELECT d.series, rep, regr_slope(value, year) AS b, regr_intercept(value, year) AS a FROM dr d JOIN an ON d.series = an.series AND d.i = an.i GROUP BY ALL),
fu AS (SELECT f.series, 2001 + k AS year, a + b * (2001 + k) AS y FROM fi f, (SELECT unnest(range(1, 6)) AS k) WHERE b IS NOT NULL)
SELECT series, year, round(quantile_cont(y, 0.025), 3) AS ci_lower, round(quantile_cont(y, 0.975), 3) AS ci_upper FROM fu GROUP BY ALL""",
)
def bootstrap_trend_band(spark, sf):
    band = RP.trend_band(annual_indexed(spark, sf), ["series"], "i", "year", "value", 5, 200, lcg_picks)
    return rounded(band, "ci_lower", "ci_upper", digits=3)


@query(
    "bootstrap_sen",
    "T15",
    f"""WITH {LEVELS_SQL}, {ANNUAL_SQL}, {DRAW_SQL}, sa AS (SELECT d.series, rep, year, value FROM dr d JOIN an ON d.series = an.series AND d.i = an.i),
se AS (SELECT a.series, a.rep, median((b.value - a.value) / (b.year - a.year)) AS s FROM sa a JOIN sa b ON a.series = b.series AND a.rep = b.rep AND a.year < b.year GROUP BY ALL)
SELECT series, round(avg(s), 5) AS mean, round(stddev_pop(s), 5) AS std, round(quantile_cont(s, 0.025), 5) AS ci_lower, round(quantile_cont(s, 0.975), 5) AS ci_upper FROM se GROUP BY series""",
)
def bootstrap_sen(spark, sf):
    return rounded(RP.sen_interval(annual_indexed(spark, sf), ["series"], "i", "year", "value", 200, lcg_picks), "mean", "std", "ci_lower", "ci_upper", digits=5)


def refits_sql(reps: int) -> str:
    """CTEs up to ``rf_fit``: the model of every replicate of the joined series by the normal equations."""
    return f"""{JOINED_SQL}, nn AS (SELECT series, count(*) AS n FROM joined GROUP BY series),
dr AS (SELECT series, rep, {LCG_SQL} AS pick FROM nn, (SELECT unnest(range(0, {reps})) AS rep), (SELECT unnest(range(0, 200)) AS place) WHERE place < n),
rf AS (SELECT d.series, rep, qty, price, disc, value FROM dr d JOIN joined j ON j.series = d.series AND j.t = d.pick), {ols3_sql('rf', 'series, rep', *XS, 'value')}"""


LEVEL_ENDS_SQL = """CAST(lv AS BIGINT) AS level, round(CASE lv WHEN 90 THEN quantile_cont({v}, 0.05) WHEN 95 THEN quantile_cont({v}, 0.025) ELSE quantile_cont({v}, 0.005) END, 4) AS ci_lower,
       round(CASE lv WHEN 90 THEN quantile_cont({v}, 0.95) WHEN 95 THEN quantile_cont({v}, 0.975) ELSE quantile_cont({v}, 0.995) END, 4) AS ci_upper"""


@query(
    "bootstrap_coefficients",
    "T18",
    f"""WITH {refits_sql(2000)}, co AS (SELECT series, unnest(['qty', 'price', 'disc']) AS name, unnest([b1, b2, b3]) AS b FROM rf_fit)
SELECT series, name, {LEVEL_ENDS_SQL.format(v='b')} FROM co, (SELECT unnest([90, 95, 99]) AS lv) GROUP BY series, name, lv""",
)
def bootstrap_coefficients(spark, sf):
    j = joined_once(spark, sf).select("series", "t", *XS, "value")
    return rounded(RP.coefficient_intervals(j, ["series"], "t", XS, "value", 2000, lcg_picks), "ci_lower", "ci_upper", digits=4)


@query(
    "prediction_bands",
    "T18",
    f"""WITH {refits_sql(2000)}, pr AS (SELECT j.series, j.t, b0 + b1 * qty + b2 * price + b3 * disc AS y FROM rf_fit f JOIN joined j ON j.series = f.series)
SELECT series, t, {LEVEL_ENDS_SQL.format(v='y')} FROM pr, (SELECT unnest([90, 95, 99]) AS lv) GROUP BY series, t, lv""",
)
def prediction_bands(spark, sf):
    """Bands of the fitted values of a regression on three predictors, from 2000 replicates."""
    j = joined_once(spark, sf).select("series", "t", *XS, "value")
    return rounded(RP.prediction_bands(j, ["series"], "t", XS, "value", 2000, lcg_picks), "ci_lower", "ci_upper", digits=4)


@query(
    "bootstrap_trend_band_1000",
    "T19",
    f"""WITH {LEVELS_SQL}, {ANNUAL_SQL}, {DRAW_SQL.replace('range(0, 200)', 'range(0, 1000)')}, fi AS (SELECT d.series, rep, regr_slope(value, year) AS b, regr_intercept(value, year) AS a FROM dr d JOIN an ON d.series = an.series AND d.i = an.i GROUP BY ALL),
fu AS (SELECT f.series, 2001 + k AS year, a + b * (2001 + k) AS y FROM fi f, (SELECT unnest(range(1, 6)) AS k) WHERE b IS NOT NULL)
SELECT series, year, round(quantile_cont(y, 0.025), 3) AS ci_lower, round(quantile_cont(y, 0.975), 3) AS ci_upper FROM fu GROUP BY ALL""",
)
def bootstrap_trend_band_1000(spark, sf):
    band = RP.trend_band(annual_indexed(spark, sf), ["series"], "i", "year", "value", 5, 1000, lcg_picks)
    return rounded(band, "ci_lower", "ci_upper", digits=3)


@query(
    "bootstrap_sen_1000",
    "T15",
    f"""WITH {LEVELS_SQL}, {ANNUAL_SQL}, {DRAW_SQL.replace('range(0, 200)', 'range(0, 1000)')}, sa AS (SELECT d.series, rep, year, value FROM dr d JOIN an ON d.series = an.series AND d.i = an.i),
se AS (SELECT a.series, a.rep, median((b.value - a.value) / (b.year - a.year)) AS s FROM sa a JOIN sa b ON a.series = b.series AND a.rep = b.rep AND a.year < b.year GROUP BY ALL)
SELECT series, round(avg(s), 5) AS mean, round(stddev_pop(s), 5) AS std, round(quantile_cont(s, 0.025), 5) AS ci_lower, round(quantile_cont(s, 0.975), 5) AS ci_upper FROM se GROUP BY series""",
)
def bootstrap_sen_1000(spark, sf):
    return rounded(RP.sen_interval(annual_indexed(spark, sf), ["series"], "i", "year", "value", 1000, lcg_picks), "mean", "std", "ci_lower", "ci_upper", digits=5)


@query(
    "residual_band",
    "T20",
    f"""WITH {LEVELS_SQL}, f AS (SELECT series, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, max(t) AS lt, count(*) AS n FROM levels GROUP BY series),
re AS (SELECT l.series, t, value - a - b * t AS e FROM levels l JOIN f USING (series)),
d AS (SELECT series, lt + k AS place, a + b * (lt + k) AS y, rep, n FROM f, (SELECT unnest(range(1, 13)) AS k), (SELECT unnest(range(0, 500)) AS rep)),
g AS (SELECT d.series, d.place AS t, d.y, d.y + e AS v FROM (SELECT *, {LCG_SQL} AS pick FROM d) d JOIN re ON re.series = d.series AND re.t = d.pick)
SELECT series, t, round(any_value(y), 4) AS forecast, round(quantile_cont(v, 0.025), 4) AS ci_lower, round(quantile_cont(v, 0.975), 4) AS ci_upper FROM g GROUP BY series, t""",
)
def residual_band(spark, sf):
    base = levels_once(spark, sf)
    line = T.ols(base, ["series"], "t", "value")
    ahead = T.future(line, 12, "t").select("series", "t", (F.col("intercept") + F.col("slope") * F.col("t")).alias("forecast"))
    res = S.detrended(base, ["series"], "t", "value").select("series", F.col("t").alias("pick"), F.col("detrended").alias("e"))
    return rounded(RS.residual_band(ahead, res, ["series"], "t", "pick", "e", 500, lcg), "forecast", "ci_lower", "ci_upper", digits=4)


@query(
    "block_length",
    "T17",
    f"""WITH {LEVELS_SQL}, c AS (SELECT b.series, b.t - a.t AS k, corr(b.value, a.value) AS rho FROM levels a JOIN levels b ON a.series = b.series AND b.t - a.t BETWEEN 1 AND 20 GROUP BY ALL),
n AS (SELECT series, count(*) AS n FROM levels GROUP BY series), s AS (SELECT series, any_value(n) AS n, sum(k * rho * k * rho) AS top, sum(rho * rho) AS bottom FROM c JOIN n USING (series) WHERE k <= least(20, n // 3) GROUP BY series)
SELECT series, n, CAST(greatest(2, least(10, round(pow(2 * top / (bottom + 1e-10) * n, 1.0 / 3)))) AS BIGINT) AS block FROM s""",
)
def block_length(spark, sf):
    return RS.block_length(levels_once(spark, sf), ["series"], "t", "value")


@query("block_bootstrap", "T16 T33 J11 W11 T21")
def block_bootstrap(spark, sf):
    """Seasonal anomalies of two periods compared by moving blocks, with adjusted p values."""
    period = F.when(F.col("year").isin(1995, 1996, 1997), "Low").when(F.col("year").isin(1999, 2000, 2001), "High")
    rows = levels_once(spark, sf).withColumn("period", period).where(F.col("period").isNotNull())
    rows = rows.withColumn("anomaly", S.anomaly("value", ["series", "period"]))
    out = RP.block_welch(rows, ["series"], "period", "Low", "High", "t", "anomaly", 500, RP.hash_draw(7))
    out = I.benjamini_hochberg(out, [], "p")
    return rounded(out, "t_stat", "p", "ci_lower", "ci_upper", "p_adjusted", digits=5)


@query(
    "bootstrap_slope_levels",
    "T18",
    f"""WITH {JOINED_SQL}, nn AS (SELECT series, count(*) AS n FROM joined GROUP BY series),
dr AS (SELECT series, rep, {LCG_SQL} AS pick FROM nn, (SELECT unnest(range(0, 100)) AS rep), (SELECT unnest(range(0, 200)) AS place) WHERE place < n),
fi AS (SELECT d.series, rep, regr_slope(value, qty) AS b FROM dr d JOIN joined j ON j.series = d.series AND j.t = d.pick GROUP BY d.series, rep)
SELECT series, 'qty' AS name, CAST(lv AS BIGINT) AS level, round(CASE lv WHEN 90 THEN quantile_cont(b, 0.05) WHEN 95 THEN quantile_cont(b, 0.025) ELSE quantile_cont(b, 0.005) END, 4) AS ci_lower,
       round(CASE lv WHEN 90 THEN quantile_cont(b, 0.95) WHEN 95 THEN quantile_cont(b, 0.975) ELSE quantile_cont(b, 0.995) END, 4) AS ci_upper
FROM fi, (SELECT unnest([90, 95, 99]) AS lv) GROUP BY series, lv""",
)
def bootstrap_slope_levels(spark, sf):
    j = joined_once(spark, sf).select("series", "t", "qty", "value")
    return rounded(RP.coefficient_intervals(j, ["series"], "t", ["qty"], "value", 100, lcg_picks), "ci_lower", "ci_upper", digits=4)


@query(
    "block_bootstrap_repeatable",
    "T16 T17 T33 J11",
    f"""WITH {LEVELS_SQL}, pr AS (SELECT *, CASE WHEN year IN (1995, 1996, 1997) THEN 'Low' WHEN year IN (1999, 2000, 2001) THEN 'High' END AS period FROM levels),
an AS (SELECT series, period, row_number() OVER (PARTITION BY series, period ORDER BY t) - 1 AS i, value - avg(value) OVER (PARTITION BY series, period, month) AS v FROM pr WHERE period IS NOT NULL),
nn AS (SELECT series, period, count(*) AS n FROM an GROUP BY ALL),
cc AS (SELECT b.series, b.period, b.i - a.i AS k, corr(b.v, a.v) AS rho FROM an a JOIN an b ON a.series = b.series AND a.period = b.period AND b.i - a.i BETWEEN 1 AND 20 GROUP BY ALL),
bl AS (SELECT series, period, any_value(n) AS n, greatest(2, least(10, round(pow(2 * sum(k * rho * k * rho) / (sum(rho * rho) + 1e-10) * any_value(n), 1.0 / 3)))) AS b FROM cc JOIN nn USING (series, period) WHERE k <= least(20, n // 3) GROUP BY series, period),
pl AS (SELECT series, period, n, CAST(least(n, max(b) OVER (PARTITION BY series)) AS BIGINT) AS b FROM bl),
dr AS (SELECT series, period, rep, place, b, n AS total, {LCG_SQL.replace('% n', '% (n - b + 1)')} AS pick FROM pl, (SELECT unnest(range(0, 200)) AS rep), (SELECT unnest(range(0, 60)) AS place) WHERE place < ceil(CAST(n AS DOUBLE) / b)),
pk AS (SELECT series, period, rep, pick + o AS i FROM dr, (SELECT unnest(range(0, 10)) AS o) WHERE o < b AND place * b + o < total),
mo AS (SELECT p.series, p.period, rep, avg(v) AS m, var_samp(v) AS s2, count(*) AS n FROM pk p JOIN an ON an.series = p.series AND an.period = p.period AND an.i = p.i GROUP BY p.series, p.period, rep),
ts AS (SELECT l.series, l.rep, (l.m - h.m) / sqrt(l.s2 / l.n + h.s2 / h.n) AS t FROM mo l JOIN mo h ON l.series = h.series AND l.rep = h.rep AND l.period = 'Low' AND h.period = 'High')
SELECT series, round(avg(t), 5) AS t_stat, round(2 * least(avg(CASE WHEN t <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN t >= 0 THEN 1.0 ELSE 0.0 END)), 6)::DOUBLE AS p, round(quantile_cont(t, 0.025), 5) AS ci_lower, round(quantile_cont(t, 0.975), 5) AS ci_upper FROM ts GROUP BY series""",
)
def block_bootstrap_repeatable(spark, sf):
    period = F.when(F.col("year").isin(1995, 1996, 1997), "Low").when(F.col("year").isin(1999, 2000, 2001), "High")
    rows = levels_once(spark, sf).withColumn("period", period).where(F.col("period").isNotNull())
    rows = rows.withColumn("anomaly", S.anomaly("value", ["series", "period"]))
    out = RP.block_welch(rows, ["series"], "period", "Low", "High", "t", "anomaly", 200, lcg_picks)
    return rounded(rounded(out, "t_stat", "ci_lower", "ci_upper", digits=5), "p")


@query(
    "block_bootstrap_500",
    "T16 T17 T33 J11 T21",
    f"""WITH {LEVELS_SQL}, pr AS (SELECT *, CASE WHEN year IN (1995, 1996, 1997) THEN 'Low' WHEN year IN (1999, 2000, 2001) THEN 'High' END AS period FROM levels),
an AS (SELECT series, period, row_number() OVER (PARTITION BY series, period ORDER BY t) - 1 AS i, value - avg(value) OVER (PARTITION BY series, period, month) AS v FROM pr WHERE period IS NOT NULL),
nn AS (SELECT series, period, count(*) AS n FROM an GROUP BY ALL),
cc AS (SELECT b.series, b.period, b.i - a.i AS k, corr(b.v, a.v) AS rho FROM an a JOIN an b ON a.series = b.series AND a.period = b.period AND b.i - a.i BETWEEN 1 AND 20 GROUP BY ALL),
bl AS (SELECT series, period, any_value(n) AS n, greatest(2, least(10, round(pow(2 * sum(k * rho * k * rho) / (sum(rho * rho) + 1e-10) * any_value(n), 1.0 / 3)))) AS b FROM cc JOIN nn USING (series, period) WHERE k <= least(20, n // 3) GROUP BY series, period),
pl AS (SELECT series, period, n, CAST(least(n, max(b) OVER (PARTITION BY series)) AS BIGINT) AS b FROM bl),
dr AS (SELECT series, period, rep, place, b, n AS total, {LCG_SQL.replace('% n', '% (n - b + 1)')} AS pick FROM pl, (SELECT unnest(range(0, 500)) AS rep), (SELECT unnest(range(0, 60)) AS place) WHERE place < ceil(CAST(n AS DOUBLE) / b)),
pk AS (SELECT series, period, rep, pick + o AS i FROM dr, (SELECT unnest(range(0, 10)) AS o) WHERE o < b AND place * b + o < total),
mo AS (SELECT p.series, p.period, rep, avg(v) AS m, var_samp(v) AS s2, count(*) AS n FROM pk p JOIN an ON an.series = p.series AND an.period = p.period AND an.i = p.i GROUP BY p.series, p.period, rep),
ts AS (SELECT l.series, l.rep, (l.m - h.m) / sqrt(l.s2 / l.n + h.s2 / h.n) AS t FROM mo l JOIN mo h ON l.series = h.series AND l.rep = h.rep AND l.period = 'Low' AND h.period = 'High'),
st AS (SELECT series, avg(t) AS t_stat, 2 * least(avg(CASE WHEN t <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN t >= 0 THEN 1.0 ELSE 0.0 END)) AS p, quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM ts GROUP BY series),
bh AS (SELECT *, row_number() OVER (ORDER BY p, series) AS i, count(*) OVER () AS m FROM st)
SELECT series, round(t_stat, 5) AS t_stat, round(p, 6)::DOUBLE AS p, round(lo, 5) AS ci_lower, round(hi, 5) AS ci_upper,
       round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS p_adjusted FROM bh""",
)
def block_bootstrap_500(spark, sf):
    """Two periods compared by 500 moving-block replicates, p adjusted over all series."""
    period = F.when(F.col("year").isin(1995, 1996, 1997), "Low").when(F.col("year").isin(1999, 2000, 2001), "High")
    rows = levels_once(spark, sf).withColumn("period", period).where(F.col("period").isNotNull())
    rows = rows.withColumn("anomaly", S.anomaly("value", ["series", "period"]))
    out = I.benjamini_hochberg(RP.block_welch(rows, ["series"], "period", "Low", "High", "t", "anomaly", 500, lcg_picks), [], "p")
    return rounded(rounded(out, "t_stat", "ci_lower", "ci_upper", digits=5), "p", "p_adjusted")


# The periods that are compared with each other.
PERIODS = {"P1": (1992, 1993), "P2": (1994, 1995), "P3": (1996, 1997), "P4": (1998, 1999), "P5": (2000, 2001)}


@query(
    "period_pairs",
    "T33 J11 T16 T17 T21 W11",
    f"""WITH {LEVELS_SQL}, pr AS (SELECT *, CASE {' '.join(f"WHEN year IN {y} THEN '{n}'" for n, y in PERIODS.items())} END AS period FROM levels),
an AS (SELECT series, period, row_number() OVER (PARTITION BY series, period ORDER BY t) - 1 AS i, value - avg(value) OVER (PARTITION BY series, period, month) AS v FROM pr WHERE period IS NOT NULL),
nn AS (SELECT series, period, count(*) AS n FROM an GROUP BY ALL),
cc AS (SELECT b.series, b.period, b.i - a.i AS k, coalesce(nullif(corr(b.v, a.v), 'nan'), 0) AS rho FROM an a JOIN an b ON a.series = b.series AND a.period = b.period AND b.i - a.i BETWEEN 1 AND 20 GROUP BY ALL),
bl AS (SELECT series, period, any_value(n) AS n, greatest(2, least(10, round(pow(2 * sum(k * rho * k * rho) / (sum(rho * rho) + 1e-10) * any_value(n), 1.0 / 3)))) AS b FROM cc JOIN nn USING (series, period) WHERE k <= least(20, n // 3) GROUP BY series, period),
pa AS (SELECT x.series, x.period AS one, y.period AS two, x.n AS n1, y.n AS n2, CAST(least(x.n, greatest(x.b, y.b)) AS BIGINT) AS l1, CAST(least(y.n, greatest(x.b, y.b)) AS BIGINT) AS l2 FROM bl x JOIN bl y ON x.series = y.series AND x.period < y.period),
pl AS (SELECT series, one AS period, n1 AS n, l1 AS b FROM pa UNION SELECT series, two, n2, l2 FROM pa),
dr AS (SELECT series, period, rep, place, b, n AS total, {LCG_SQL.replace('% n', '% (n - b + 1)')} AS pick FROM pl, (SELECT unnest(range(0, 500)) AS rep), (SELECT unnest(range(0, 60)) AS place) WHERE place < ceil(CAST(n AS DOUBLE) / b)),
pk AS (SELECT series, period, b, rep, pick + o AS i FROM dr, (SELECT unnest(range(0, 10)) AS o) WHERE o < b AND place * b + o < total),
mo AS (SELECT p.series, p.period, p.b, rep, avg(v) AS m, var_samp(v) AS s2, count(*) AS n FROM pk p JOIN an ON an.series = p.series AND an.period = p.period AND an.i = p.i GROUP BY ALL),
ts AS (SELECT pa.series, one, two, (x.m - y.m) / sqrt(x.s2 / x.n + y.s2 / y.n) AS t FROM pa JOIN mo x ON x.series = pa.series AND x.period = one AND x.b = l1 JOIN mo y ON y.series = pa.series AND y.period = two AND y.b = l2 AND y.rep = x.rep),
st AS (SELECT series, one, two, avg(t) AS t_stat, 2 * least(avg(CASE WHEN t <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN t >= 0 THEN 1.0 ELSE 0.0 END)) AS p, quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM ts GROUP BY ALL),
bh AS (SELECT *, row_number() OVER (ORDER BY p, series, one, two) AS i, count(*) OVER () AS m FROM st)
SELECT series, one, two, round(t_stat, 5) AS t_stat, round(p, 6)::DOUBLE AS p, round(lo, 5) AS ci_lower, round(hi, 5) AS ci_upper,
       round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS p_adjusted FROM bh""",
)
def period_pairs(spark, sf):
    """Seasonal anomalies of every two periods compared by moving blocks, p adjusted over all pairs and series."""
    period = F.coalesce(*[F.when(F.col("year").isin(*years), name) for name, years in PERIODS.items()])
    rows = levels_once(spark, sf).withColumn("period", period).where(F.col("period").isNotNull())
    rows = rows.withColumn("anomaly", S.anomaly("value", ["series", "period"]))
    out = RP.block_welch_pairs(rows, ["series"], "period", list(PERIODS), "t", "anomaly", 500, lcg_picks)
    return rounded(rounded(I.benjamini_hochberg_family(out, "p"), "t_stat", "ci_lower", "ci_upper", digits=5), "p", "p_adjusted")


@query(
    "harmonic_single_forecast",
    "M29 F11",
    f"""WITH {LEVELS_SQL}, li AS (SELECT series, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, max(t) AS lt, max(date) AS ld FROM levels GROUP BY series),
de AS (SELECT l.series, t, month, value - a - b * t AS d FROM levels l JOIN li USING (series)), se AS (SELECT series, month, avg(d) AS sn FROM de GROUP BY ALL),
re AS (SELECT de.series, cos(t * (2 * pi() / 8.7)) AS c, sin(t * (2 * pi() / 8.7)) AS s, d - sn AS y FROM de JOIN se USING (series, month)),
g AS (SELECT series, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(c * y) AS cy, sum(s * y) AS sy FROM re GROUP BY series),
h AS (SELECT series, {cramer2('cc', 'cs', 'ss', 'cy', 'sy')[0]} AS ka, {cramer2('cc', 'cs', 'ss', 'cy', 'sy')[1]} AS kb FROM g),
fu AS (SELECT series, a, b, CAST(ld + to_months(CAST(k AS INTEGER)) AS DATE) AS date, lt + k AS t FROM li, (SELECT unnest(range(1, 25)) AS k))
SELECT fu.series, date, year(date) AS year, month(date) AS month, t, round(a + b * t + coalesce(sn, 0) + ka * cos(t * (2 * pi() / 8.7)) + kb * sin(t * (2 * pi() / 8.7)), 4) AS forecast
FROM fu JOIN h USING (series) LEFT JOIN se ON se.series = fu.series AND se.month = month(fu.date)""",
)
def harmonic_single_forecast(spark, sf):
    return rounded(FC.harmonic_forecast(levels_once(spark, sf), ["series"], "t", "value", 24, (8.7,)), "forecast", digits=4)
