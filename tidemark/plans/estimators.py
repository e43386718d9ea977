"""Tree ensembles, components, selection and whole-series estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attributions as A
from tidemark.operators import changepoint as P
from tidemark.operators import forecast as FC
from tidemark.operators import inference as I
from tidemark.operators import ml as M
from tidemark.operators import regress as G
from tidemark.operators import relational as R
from tidemark.operators import series as S
from tidemark.operators import univariate as U
from tidemark.plans.base import JOINED_SQL, LEVELS_SQL, joined, joined_once, levels, levels_once, query, r, rounded
from tidemark.plans.models import ols3_sql
from tidemark.session import cut_lineage

XS = ("qty", "price", "disc")
LAGGED = ("value_lag1", "value_lag2", "value_lag3", "qty", "price", "disc", "qty_lag1", "sin", "cos")


def lagged_features(spark, sf):
    """Monthly rows with lags, season and predictors; rows with an incomplete history drop out."""
    rows = S.lags(joined(spark, sf), ["series"], "t", ["value", "qty"], (1, 2, 3)).withColumns(P.season_features("t", F.lit(100.0)))
    return cut_lineage(rows.select("series", "t", "year", "value", *LAGGED).na.drop())  # fits and folds read them again and again


# ------------------------------------------------------------------ whole-series estimators

LINES_SQL = """pts AS (SELECT series, CAST(t AS DOUBLE) AS x, value AS y FROM levels),
ln AS (SELECT a.series, (b.y - a.y) / (b.x - a.x) AS s, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM pts a JOIN pts b ON a.series = b.series AND a.x < b.x)"""


@query(
    "quantile_regression",
    "T22",
    f"WITH {LEVELS_SQL}, {LINES_SQL}, "
    + ", ".join(
        f"l{i} AS (SELECT ln.series, s, sum(CASE WHEN y - s * x - c >= 0 THEN {t} * (y - s * x - c) ELSE ({t} - 1) * (y - s * x - c) END) AS loss FROM ln JOIN pts ON ln.series = pts.series GROUP BY ln.series, s, c)"
        for i, t in enumerate((0.1, 0.5, 0.9))
    )
    + " "
    + " UNION ALL ".join(
        f"SELECT series, CAST({t} AS DOUBLE) AS tau, round(min(s), 6) AS slope FROM (SELECT *, min(loss) OVER (PARTITION BY series) AS least_loss FROM l{i}) WHERE loss <= least_loss * (1 + 1e-10) GROUP BY series"
        for i, t in enumerate((0.1, 0.5, 0.9))
    ),  # the smallest slope where several are optimal
)
def quantile_regression(spark, sf):
    q = U.quantile_slopes(levels(spark, sf), ["series"], "t", "value")
    return rounded(q.select("series", "tau", "slope"), "slope")


@query("unit_root", "T24")
def unit_root(spark, sf):
    return rounded(U.unit_root(levels(spark, sf), ["series"], "t", "value"), "stat", "p", digits=5)


@query("arima_forecast", "M24")
def arima_forecast(spark, sf):
    return rounded(U.arima(levels(spark, sf), ["series"], "t", "value", 12, (1, 0, 1)), "forecast", "sigma", digits=3)


@query("seasonal_arima_forecast", "M21 M24")
def seasonal_arima_forecast(spark, sf):
    return rounded(U.arima(joined(spark, sf), ["series"], "t", "value", 12, (1, 0, 1), (1, 0, 1), 12, ["qty"]), "forecast", "sigma", digits=3)


@query("gaussian_process", "M18 M16")
def gaussian_process(spark, sf):
    rows = joined(spark, sf).withColumn("time", F.col("t").cast("double"))
    g = U.gaussian_process(rows, ["series"], "t", ["time", *XS], "value", F.col("year") <= 1999)
    return rounded(g, "prediction", "sd", digits=3)


@query("ard_regression", "M19")
def ard_regression(spark, sf):
    return rounded(U.ard(joined(spark, sf), ["series"], XS, "value"), "coefficient", digits=4)


@query("additive_forecast", "M25 M35")
def additive_forecast(spark, sf):
    return rounded(U.additive_forecast(levels_once(spark, sf), ["series"], "t", "value", 24), "forecast", digits=3)


@query(
    "constant_forecast",
    "M22",
    f"WITH {LEVELS_SQL}, m AS (SELECT series, avg(value) AS v FROM levels GROUP BY series) SELECT series, k AS step, round(v, 5) AS forecast FROM m, (SELECT unnest(range(1, 6)) AS k)",
)
def constant_forecast(spark, sf):
    return rounded(U.mean_forecast(levels(spark, sf), ["series"], "value", 5), "forecast", digits=5)


@query("kernel_change_points", "B3")
def kernel_change_points(spark, sf):
    return P.pelt(levels(spark, sf), ["series"], "t", "value", 5.0)


# ------------------------------------------------------------------ linear families


@query(
    "spline_free_gam",
    "M20 M1",
    f"""WITH {LEVELS_SQL}, p AS (SELECT series, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM levels GROUP BY series)
SELECT l.series, t, round(a + b * t, 5) AS prediction FROM levels l JOIN p USING (series)""",
)
def spline_free_gam(spark, sf):
    """The additive model of the benchmark set: linear terms only."""
    base = levels_once(spark, sf)
    out = G.predict(base, G.fit(base, ["series"], ["t"], "value"), ["series"], ["t"])
    return rounded(out.select("series", "t", "prediction"), "prediction", digits=5)


@query(
    "model_equation",
    "M33",
    f"""WITH {LEVELS_SQL}, p AS (SELECT series, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM levels GROUP BY series)
SELECT series, 'level = ' || printf('%.3f', a) || ' + ' || printf('%.3f', b) || '*t' AS equation FROM p""",
)
def model_equation(spark, sf):
    return G.fit(levels(spark, sf), ["series"], ["t"], "value").select("series", G.equation("level", ["t"], 3).alias("equation"))


@query(
    "linear_attributions",
    "M10 M9",
    f"""WITH {LEVELS_SQL}, p AS (SELECT series, regr_slope(value, t) AS b, avg(t) AS m FROM levels GROUP BY series)
SELECT l.series, 't' AS name, round(avg(abs(b * (t - m))), 5) AS importance FROM levels l JOIN p USING (series) GROUP BY l.series""",
)
def linear_attributions(spark, sf):
    base = levels_once(spark, sf)
    return rounded(M.linear_attributions(base, G.fit(base, ["series"], ["t"], "value"), ["series"], ["t"]), "importance", digits=5)


@query(
    "attribution_ranking",
    "M10 A26",
    f"""WITH {JOINED_SQL}, {ols3_sql('joined', 'series', *XS, 'value')}, a AS (SELECT j.series, avg(abs(b1 * (qty - m1))) AS i1, avg(abs(b2 * (price - m2))) AS i2, avg(abs(b3 * (disc - m3))) AS i3 FROM joined j JOIN joined_fit USING (series) GROUP BY j.series)
SELECT 'qty' AS name, round(avg(i1), 4) AS importance FROM a UNION ALL SELECT 'price', round(avg(i2), 4) FROM a UNION ALL SELECT 'disc', round(avg(i3), 4) FROM a""",
)
def attribution_ranking(spark, sf):
    j = joined_once(spark, sf)
    a = M.linear_attributions(j, G.fit(j, ["series"], XS, "value"), ["series"], XS)
    return rounded(R.top_abs(a.groupBy("name").agg(F.avg("importance").alias("importance")), "importance", 20, "name"), "importance", digits=4)


@query("backward_elimination", "M9 M15")
def backward_elimination(spark, sf):
    return rounded(M.backward_elimination(joined_once(spark, sf), ["series"], "t", list(XS), "value"), "mse", digits=3)


@query("lasso_cv", "M5 M15")
def lasso_cv(spark, sf):
    grid = [10 ** (-2 + 3 * i / 19) for i in range(20)]
    cv = G.time_series_cv(joined_once(spark, sf), ["series"], "t", list(XS), "value", 5, lassos=grid)
    return rounded(rounded(G.best_penalty(cv, ["series"]), "penalty", digits=6), "mse", digits=3)


@query(
    "pca_two_columns",
    "C8",
    f"""WITH {JOINED_SQL}, c AS (SELECT series, corr(value, qty) AS r FROM joined GROUP BY series)
SELECT series, component, name, round(CASE WHEN name = 'value' OR (component = 1) = (r >= 0) THEN sqrt(0.5) ELSE -sqrt(0.5) END, 8) AS loading, round(CASE component WHEN 1 THEN (1 + abs(r)) / 2 ELSE (1 - abs(r)) / 2 END, 8) AS variance_share
FROM c, (SELECT unnest(range(1, 3)) AS component), (SELECT unnest(['value', 'qty']) AS name)""",
)
def pca_two_columns(spark, sf):
    return rounded(M.principal_components(joined(spark, sf), ["series"], ["value", "qty"]), "loading", "variance_share", digits=8)


@query("pca_loadings", "C8")
def pca_loadings(spark, sf):
    return rounded(M.principal_components(joined(spark, sf), ["series"], ["value", *XS]), "loading", "variance_share", digits=6)


# ------------------------------------------------------------------ tree ensembles


@query("rf_importance", "M11 C9 M33")
def rf_importance(spark, sf):
    model = M.forest(trees=200, depth=5).fit(M.assemble(lagged_features(spark, sf), LAGGED))
    return rounded(M.importances(spark, model, LAGGED), "importance", digits=4)


@query("weighted_forest", "M11 P17")
def weighted_forest(spark, sf):
    from tidemark.functions import columns as C

    rows = lagged_features(spark, sf).withColumn("w", C.step_weight("year", ((2000, 8.0), (1998, 4.0), (1996, 2.0))))
    model = M.forest(trees=200, depth=5, leaf=5, weight="w").fit(M.assemble(rows.where(F.col("year") <= 2000), LAGGED))
    out = model.transform(M.assemble(rows.where(F.col("year") > 2000), LAGGED))
    return rounded(I.metrics(out, ["series"], "value", "prediction"), "r2", "rmse", "mae", "mape", digits=3)


@query("boosted_trees", "M12 M16")
def boosted_trees(spark, sf):
    rows = lagged_features(spark, sf)
    model = M.boosted(rounds=100, depth=3).fit(M.assemble(rows.where(F.col("year") <= 1999), LAGGED))
    out = model.transform(M.assemble(rows.where(F.col("year") > 1999), LAGGED))
    return rounded(I.metrics(out, ["series"], "value", "prediction"), "r2", "rmse", "mae", "mape", digits=3)


@query("permutation_importance", "M10")
def permutation_importance(spark, sf):
    rows = lagged_features(spark, sf)
    model = M.forest(trees=100, depth=4).fit(M.assemble(rows, XS))
    return rounded(M.permutation_importance(rows, model, XS, ["series", "t"]), "importance", digits=3)


@query(
    "tree_attributions",
    "M10",
    f"""WITH {JOINED_SQL}, rows AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS i FROM joined)
SELECT series, count(*) AS n, 0.0::DOUBLE AS largest_gap FROM rows WHERE i > 3 GROUP BY series""",
)
def tree_attributions(spark, sf):
    """Attributions of every row by a forest: how far they are, at most, from adding up to the prediction less the mean."""
    rows = lagged_features(spark, sf)
    model = M.forest(trees=100, depth=5).fit(M.assemble(rows, LAGGED))
    whole = F.aggregate(A.attributions(model, LAGGED), F.lit(A.paths(model).base), lambda a, b: a + b)
    gaps = model.transform(M.assemble(rows, LAGGED)).withColumn("gap", F.abs(whole - F.col("prediction")))
    return rounded(gaps.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("largest_gap")), "largest_gap")


@query("attribution_top", "M10")
def attribution_top(spark, sf):
    rows = lagged_features(spark, sf)
    model = M.boosted(rounds=100, depth=3).fit(M.assemble(rows.where(F.col("year") <= 2000), LAGGED))
    return rounded(A.importance(rows.where(F.col("year") > 2000), model, LAGGED, 20), "importance", digits=3)


@query("attribution_elimination", "M9")
def attribution_elimination(spark, sf):
    rows = lagged_features(spark, sf)
    return rounded(A.elimination(rows, "t", M.forest(trees=50, depth=4), LAGGED[:6], "value", 5), "r2", digits=3)


@query("recursive_elimination", "M6 M7 A24")
def recursive_elimination(spark, sf):
    rows = lagged_features(spark, sf)
    kept = M.recursive_elimination(rows, LAGGED, 5, M.forest(trees=50, depth=4))
    penalised = G.coefficients(G.fit(rows.withColumn("g", F.lit(1)), ["g"], LAGGED, "value", lasso=0.01), ["g"], LAGGED)
    chosen = [x.name for x in penalised.where(F.abs("coefficient") > 0.01).orderBy("name").collect()]  # one row per feature
    names = [F.struct(F.lit(n).alias("name")) for n in M.selected_by_both(chosen, kept)]
    return spark.range(1).select(F.inline(F.array(*names)))


@query("grid_search_cv", "M13 M14 M17")
def grid_search_cv(spark, sf):
    rows = lagged_features(spark, sf).withColumn("fold", M.random_fold(5, "series", "t"))
    candidates = {f"trees={n} depth={d}": M.forest(trees=n, depth=d) for n in (100, 200) for d in (5, 10)}
    return rounded(M.grid_search(rows, "fold", candidates, LAGGED, "value"), "rmse", "r2", digits=3)


@query("stacked_ensemble", "M23 M14")
def stacked_ensemble(spark, sf):
    rows = lagged_features(spark, sf).withColumn("fold", M.random_fold(3, "series", "t"))
    bases = {"rf": M.forest(trees=100, depth=4), "gbt": M.boosted(rounds=50, depth=3), "shallow": M.forest(trees=100, depth=2, seed=7)}
    out = M.stack(rows, "fold", bases, LAGGED, "value", ["series", "t"])
    return rounded(I.metrics(out, ["series"], "actual", "stacked"), "r2", "rmse", "mae", "mape", digits=3)


@query(
    "external_validation",
    "M34 J2",
    f"""WITH {JOINED_SQL}, src AS (SELECT 1 AS g, * FROM joined WHERE series = '1-URGENT'), {ols3_sql('src', 'g', *XS, 'value')},
e AS (SELECT j.series, value, value - (b0 + b1 * qty + b2 * price + b3 * disc) AS e FROM joined j, src_fit WHERE j.series <> '1-URGENT')
SELECT series, round(1 - sum(e * e) / regr_syy(value, value), 4) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(100 * avg(abs(e / value)), 4) AS mape, count(*) AS n FROM e GROUP BY series""",
)
def external_validation(spark, sf):
    """One model, fitted on one series and scored on each of the others."""
    rows = joined_once(spark, sf)
    model = G.fit(rows.where(F.col("series") == "1-URGENT"), ["series"], XS, "value")
    scored = G.predict_with(rows.where(F.col("series") != "1-URGENT"), model, XS)
    return rounded(I.metrics(scored, ["series"], "value", "prediction"), "r2", "rmse", "mae", "mape", digits=4)


@query("future_at_mean", "M35 S16", f"WITH {JOINED_SQL}, m AS (SELECT series, avg(qty) AS qty, avg(price) AS price FROM joined GROUP BY series) SELECT series, k AS step, round(qty, 6) AS qty, round(price, 6) AS price FROM m, (SELECT unnest(range(1, 6)) AS k)")
def future_at_mean(spark, sf):
    return rounded(FC.mean_features(joined(spark, sf), ["series"], ["qty", "price"], 5), "qty", "price")


@query(
    "annual_rollup",
    "M35 A2",
    f"WITH {JOINED_SQL} SELECT series, year, round(avg(value), 5) AS value, round(avg(qty), 5) AS qty FROM joined GROUP BY ALL",
)
def annual_rollup(spark, sf):
    out = FC.annual_rollup(joined(spark, sf), ["series"], ["value", "qty"])
    return out.select("series", "year", r("value", 5).alias("value"), r("qty", 5).alias("qty"))
