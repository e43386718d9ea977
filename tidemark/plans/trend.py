"""Trends, hypothesis tests, correlation, extremes and multiple-testing control."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import concordance as K
from tidemark.operators import inference as I
from tidemark.operators import relational as R
from tidemark.operators import series as S
from tidemark.operators import trend as T
from tidemark.plans.base import JOINED_SQL, LEVELS_SQL, OBS_SQL, joined, levels, levels_once, observations, query, r, rounded, table

# ------------------------------------------------------------------ SQL forms of the distributions


def integral(f: str, upper: str, steps: int = 2000) -> str:
    """Simpson integral of ``f(x)`` from 0 to ``upper`` as a DuckDB expression."""
    h = f"(({upper}) / {steps}.0)"
    terms = f"list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)::DOUBLE * ({f.replace('{x}', f'(i::DOUBLE * {h})')}))"
    return f"(list_sum({terms}) * {h} / 3.0)"


def normal_p(z: str) -> str:
    return f"abs(1 - 2 * {integral('exp(-{x} * {x} / 2) / sqrt(2 * pi())', f'least(abs({z}), 40)')})"


def t_p(t: str, df: str) -> str:
    pdf = "pow(1 + {x} * {x} / (" + df + "), -((" + df + ") + 1) / 2)"
    return f"abs(1 - 2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * {integral(pdf, f'abs({t})')})"


def pairs_sql(source: str, x: str = "t", y: str = "value") -> str:
    return f"""pairs AS (SELECT a.series, a.{x} AS xi, b.{x} AS xj, a.{y} AS yi, b.{y} AS yj FROM {source} a JOIN {source} b ON a.series = b.series AND a.{x} < b.{x})"""


def mk_sql(source: str) -> str:
    return f"""{pairs_sql(source)},
s AS (SELECT series, CAST(sum(CASE WHEN yj > yi THEN 1 WHEN yj < yi THEN -1 ELSE 0 END) AS BIGINT) AS s FROM pairs GROUP BY series),
ties AS (SELECT series, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT series, value, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY ALL) GROUP BY series),
v AS (SELECT series, s, n, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var_s FROM s JOIN ties USING (series)),
z AS (SELECT *, (s - sign(s)) / sqrt(var_s) AS z FROM v)
SELECT series, s, CAST(n AS BIGINT) AS n, round(var_s, 4) AS var_s, round(s / (n * (n - 1) / 2), 8) AS tau, round(z, 8) AS z, round({normal_p('z')}, 7) AS p FROM z"""


@query("mann_kendall", "T1 J10", f"WITH {LEVELS_SQL}, {mk_sql('levels')}")
def mann_kendall(spark, sf):
    mk = T.mann_kendall(levels(spark, sf), ["series"], "t", "value").drop("trend")
    return rounded(rounded(rounded(mk, "var_s", digits=4), "tau", "z", digits=8), "p", digits=7)


@query(
    "mann_kendall_label",
    "T3",
    f"""WITH {LEVELS_SQL}, mk AS ({{sql}}), sl AS ({pairs_sql('levels').removeprefix('pairs AS (').removesuffix(')')})
SELECT mk.series, CASE WHEN p < 0.05 AND z > 0 THEN 'increasing' WHEN p < 0.05 AND z < 0 THEN 'decreasing' ELSE 'no trend' END AS trend, round(median((yj - yi) / (xj - xi)), 8) AS slope
FROM mk JOIN sl ON sl.series = mk.series GROUP BY mk.series, p, z""".replace("{sql}", "WITH " + mk_sql("levels")),
)
def mann_kendall_label(spark, sf):
    """Direction of the trend at 5 % beside its slope by position."""
    base = levels_once(spark, sf)
    label = T.mann_kendall(base, ["series"], "t", "value").select("series", "trend")
    return rounded(label.join(T.theil_sen(base, ["series"], "t", "value"), "series"), "slope", digits=8)


@query("mann_kendall_obs", "T1 D5", f"WITH {OBS_SQL}, {mk_sql('obs')}")
def mann_kendall_obs(spark, sf):
    """Over irregular observations: series of any length, by the concordance of position and value."""
    mk = T.mann_kendall_long(observations(spark, sf), ["series"], "t", "value").drop("trend")
    return rounded(rounded(rounded(mk, "var_s", digits=4), "tau", "z", digits=8), "p", digits=7)


@query(
    "theil_sen_obs",
    "T4",
    f"""WITH obs AS (SELECT event_type AS series, date_diff('minute', TIMESTAMP '1992-01-01', ts) AS x, value FROM events WHERE value IS NOT NULL)
SELECT a.series, round(median((b.value - a.value) / (b.x - a.x)) * 1e6, 5) AS slope_per_million FROM obs a JOIN obs b ON a.series = b.series AND a.x < b.x GROUP BY a.series""",
)
def theil_sen_obs(spark, sf):
    """Over irregular observations, slope by the minute: series of any length, by counts of discordant pairs."""
    minutes = F.expr("timestampdiff(MINUTE, timestamp_ntz'1992-01-01 00:00:00', ts)")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("series"), minutes.alias("x"), "value")
    return K.theil_sen_long(rows, ["series"], "x", "value").select("series", r(F.col("slope") * 1e6, 5).alias("slope_per_million"))


@query("kendall_obs", "T8", f"WITH obs AS (SELECT event_type AS series, hour(ts) AS x, round(value) AS y FROM events WHERE value IS NOT NULL), c AS (SELECT series, x, y, count(*) AS w FROM obs GROUP BY ALL), p AS (SELECT a.series, sum(a.w * b.w * sign(b.x - a.x) * sign(b.y - a.y)) / 2 AS s, sum(a.w * b.w * CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS sx, sum(a.w * b.w * CASE WHEN a.y = b.y THEN 1 ELSE 0 END) AS sy, sum(a.w * b.w) AS n2 FROM c a JOIN c b ON a.series = b.series GROUP BY a.series) SELECT series, round(s / sqrt((n2 - sx) / 2.0 * (n2 - sy) / 2.0), 7) AS tau_b FROM p")
def kendall_obs(spark, sf):
    """Hour of the day and value of irregular observations, with ties in both."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("series"), F.hour("ts").alias("x"), F.round("value").alias("y"))
    return rounded(K.kendall_tau_b(rows, ["series"], "x", "y"), "tau_b", digits=7)


@query("sen_slope_index", "T2", f"WITH {LEVELS_SQL}, {pairs_sql('levels')} SELECT series, round(median((yj - yi) / (xj - xi)), 8) AS slope FROM pairs GROUP BY series")
def sen_slope_index(spark, sf):
    return rounded(T.theil_sen(levels(spark, sf), ["series"], "t", "value"), "slope", digits=8)


@query(
    "theil_sen",
    "T4",
    f"""WITH {LEVELS_SQL}, {pairs_sql('levels', 'year')}
SELECT series, round(median((yj - yi) / (xj - xi)), 7) AS slope FROM pairs GROUP BY series""",
)
def theil_sen(spark, sf):
    return rounded(T.theil_sen(levels(spark, sf), ["series"], "year", "value"), "slope", digits=7)


@query(
    "pettitt_std",
    "T5",
    f"""WITH {LEVELS_SQL}, u AS (SELECT a.series, a.t, (SELECT sum(CASE WHEN i.value > j.value THEN 1 WHEN i.value < j.value THEN -1 ELSE 0 END)
   FROM levels i JOIN levels j ON i.series = j.series WHERE i.series = a.series AND i.t <= a.t AND j.t > a.t) AS u FROM levels a),
n AS (SELECT series, CAST(count(*) AS DOUBLE) AS n FROM levels GROUP BY series),
k AS (SELECT series, t, coalesce(abs(u), 0) AS k, row_number() OVER (PARTITION BY series ORDER BY coalesce(abs(u), 0) DESC, t) AS rn FROM u)
SELECT series, t AS change_index, CAST(k AS DOUBLE) AS k, round(least(1.0, 2 * exp(-6 * k * k / (n * n * n + n * n))), 8) AS p FROM k JOIN n USING (series) WHERE rn = 1""",
)
def pettitt_std(spark, sf):
    return rounded(T.pettitt(levels(spark, sf), ["series"], "t", "value").drop("n"), "p", digits=8)


@query(
    "pettitt_ref",
    "T5",
    f"""WITH {LEVELS_SQL}, c AS (SELECT a.series, a.t, (SELECT coalesce(sum(CASE WHEN a.value > j.value THEN 1 WHEN a.value < j.value THEN -1 ELSE 0 END), 0)
   FROM levels j WHERE j.series = a.series AND j.t < a.t) AS c FROM levels a),
u AS (SELECT series, t, abs(sum(c) OVER (PARTITION BY series ORDER BY t)) AS k, count(*) OVER (PARTITION BY series) AS n FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY k DESC, t) AS rn FROM u)
SELECT series, t AS change_index, CAST(k AS DOUBLE) AS k, round(2 * exp(-6 * CAST(k AS DOUBLE) * k / (CAST(n AS DOUBLE) * n * n + n * n)), 8) AS p FROM b WHERE rn = 1""",
)
def pettitt_ref(spark, sf):
    return rounded(T.pettitt_sequential(levels(spark, sf), ["series"], "t", "value").drop("n"), "p", digits=8)


@query(
    "ols_trend_test",
    "T6 M1",
    f"""WITH {LEVELS_SQL}, f AS (SELECT series, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept, regr_r2(value, t) AS r2, count(*) AS n FROM levels GROUP BY series),
g AS (SELECT *, sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)) AS t_stat, CAST(n - 2 AS DOUBLE) AS dof FROM f)
SELECT series, round(slope, 7) AS slope, round(intercept, 5) AS intercept, round(r2, 7) AS r2, n, round(t_stat, 6) AS t_stat, round({t_p('t_stat', 'dof')}, 7) AS p FROM g""",
)
def ols_trend_test(spark, sf):
    fit = T.ols_tested(levels(spark, sf), ["series"], "t", "value").select("series", "slope", "intercept", "r2", "n", "t_stat", "p")
    return rounded(rounded(rounded(fit, "slope", "r2", "p", digits=7), "intercept", digits=5), "t_stat", digits=6)


@query(
    "trend_t_interval",
    "T28 M1",
    f"""WITH {LEVELS_SQL}, a AS (SELECT series, year, avg(value) AS value FROM levels GROUP BY ALL),
f AS (SELECT series, regr_slope(value, year) AS b, regr_intercept(value, year) AS a, count(*) AS n, max(year) AS last, avg(year) AS mx, regr_sxx(value, year) AS sxx, regr_syy(value, year) AS syy FROM a GROUP BY series),
h AS (SELECT *, last + k AS year, a + b * (last + k) AS forecast, (syy - b * b * sxx) / n AS mse FROM f, (SELECT unnest(range(1, 6)) AS k)),
w AS (SELECT *, (CASE n WHEN 7 THEN 2.5705818356363146 WHEN 6 THEN 2.7764451051977987 END) * sqrt(mse * (1 + 1.0 / n + (year - mx) * (year - mx) / sxx)) AS half FROM h)
SELECT series, year, round(forecast, 4) AS forecast, round(forecast - half, 4) AS lower, round(forecast + half, 4) AS upper FROM w""",
)
def trend_t_interval(spark, sf):
    annual = R.annual_mean(levels(spark, sf), "value", ["series"])
    return rounded(T.forecast_t_interval(annual, ["series"], "year", "value", 5), "forecast", "lower", "upper", digits=4)


@query(
    "wls_trend",
    "M2 P18",
    f"""WITH {LEVELS_SQL}, w AS (SELECT series, CAST(t AS DOUBLE) AS x, value AS y, CAST(t + 1 AS DOUBLE) AS w FROM levels),
m AS (SELECT series, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY series),
b AS (SELECT w.series, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope, any_value(mx) AS mx, any_value(my) AS my FROM w JOIN m USING (series) GROUP BY w.series),
c AS (SELECT series, slope, my - slope * mx AS intercept FROM b)
SELECT c.series, round(any_value(slope), 7) AS slope, round(any_value(intercept), 5) AS intercept,
       round(1 - sum((y - intercept - slope * x) * (y - intercept - slope * x)) / regr_syy(y, y), 7) AS r2, count(*) AS n
FROM w JOIN c USING (series) GROUP BY c.series""",
)
def wls_trend(spark, sf):
    fit = T.weighted_ols(levels(spark, sf), ["series"], "t", "value", F.col("t") + 1)
    return rounded(rounded(fit, "slope", "r2", digits=7), "intercept", digits=5)


@query(
    "slope_windows",
    "T30",
    f"""WITH {LEVELS_SQL}, a AS (SELECT series, year, avg(value) AS value FROM levels GROUP BY ALL)
SELECT series, start, round(regr_slope(value, year), 6) AS slope, round(regr_r2(value, year), 6) AS r2, count(*) AS n
FROM a JOIN (VALUES (1995::BIGINT), (1996), (1997), (1998), (1999)) w(start) ON year BETWEEN start AND 2001 GROUP BY ALL""",
)
def slope_windows(spark, sf):
    annual = R.annual_mean(levels(spark, sf), "value", ["series"])
    return rounded(T.slope_windows(annual, ["series"], "year", "value", range(1995, 2000), 2001), "slope", "r2")


# ------------------------------------------------------------------ correlation

COLS = ("value", "qty", "price", "disc")
PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]


@query(
    "pearson_matrix",
    "T8",
    f"WITH {JOINED_SQL} " + " UNION ALL ".join(f"SELECT series, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM joined GROUP BY series" for a, b in PAIRS),
)
def pearson_matrix(spark, sf):
    return rounded(I.correlation_pairs(joined(spark, sf), ["series"], COLS), "r", digits=8)


RANKS_SQL = "ranked AS (SELECT series, " + ", ".join(
    f"rank() OVER (PARTITION BY series ORDER BY {c}) + (count(*) OVER (PARTITION BY series, {c}) - 1) / 2.0 AS {c}" for c in COLS
) + " FROM joined)"


@query(
    "spearman_matrix",
    "T8 W16",
    f"WITH {JOINED_SQL}, {RANKS_SQL} " + " UNION ALL ".join(f"SELECT series, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM ranked GROUP BY series" for a, b in PAIRS),
)
def spearman_matrix(spark, sf):
    return rounded(I.spearman_pairs(joined(spark, sf), ["series"], COLS), "r", digits=8)


@query(
    "kendall_tau_b",
    "T8 J10",
    f"""WITH {LEVELS_SQL}, p AS (SELECT a.series, sign(b.n_obs - a.n_obs) * sign(b.value - a.value) AS c, a.n_obs = b.n_obs AS tx, a.value = b.value AS ty
  FROM levels a JOIN levels b ON a.series = b.series AND a.t < b.t)
SELECT series, round(sum(c) / sqrt(CAST(count(*) - count_if(tx) AS DOUBLE) * CAST(count(*) - count_if(ty) AS DOUBLE)), 8) AS tau_b FROM p GROUP BY series""",
)
def kendall_tau_b(spark, sf):
    return rounded(T.kendall_tau_b(levels(spark, sf), ["series"], "n_obs", "value"), "tau_b", digits=8)


@query(
    "pearson_p",
    "T7 P25",
    f"""WITH {JOINED_SQL}, c AS (SELECT series, corr(value, qty) AS r, count(*) AS n FROM joined GROUP BY series),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t_stat, CAST(n - 2 AS DOUBLE) AS dof FROM c)
SELECT series, round(r, 8) AS r, n, round(t_stat, 6) AS t_stat, round({t_p('t_stat', 'dof')}, 7) AS p FROM t""",
)
def pearson_p(spark, sf):
    return rounded(rounded(rounded(I.pearson(joined(spark, sf), ["series"], "value", "qty"), "r", digits=8), "t_stat"), "p", digits=7)


def partial_sql(x: str, a: str, b: str) -> str:
    """Correlation with ``value`` given ``b``, then given ``a`` as well."""
    pair = lambda p, q: ("y" + p[0] if q == "y" else "".join(n[0] for n in ("qty", "price", "disc") if n in (p, q)))
    given_b = lambda p, q: f"(({pair(p, q)} - {pair(b, q) if q == 'y' else pair(q, b)} * {pair(p, b)}) / sqrt((1 - pow({pair(b, q) if q == 'y' else pair(q, b)}, 2)) * (1 - pow({pair(p, b)}, 2))))"
    yx, ya, xa = given_b(x, "y"), given_b(a, "y"), given_b(x, a)
    return f"SELECT series, n, '{x}' AS name, ({yx} - {ya} * {xa}) / sqrt((1 - pow({ya}, 2)) * (1 - pow({xa}, 2))) AS r FROM c"


@query(
    "partial_corr",
    "T9",
    f"""WITH {JOINED_SQL}, c AS (SELECT series, corr(value, qty) AS yq, corr(value, price) AS yp, corr(value, disc) AS yd, corr(qty, price) AS qp, corr(qty, disc) AS qd, corr(price, disc) AS pd, count(*) AS n FROM joined GROUP BY series),
g AS ({' UNION ALL '.join(partial_sql(*names) for names in (('qty', 'price', 'disc'), ('price', 'qty', 'disc'), ('disc', 'qty', 'price')))}),
h AS (SELECT *, r * sqrt((n - 4) / (1 - r * r)) AS t_stat, CAST(n - 4 AS DOUBLE) AS dof FROM g)
SELECT series, name, round(r, 7) AS r, round(t_stat, 6) AS t_stat, round({t_p('t_stat', 'dof')}, 6) AS p FROM h""",
)
def partial_corr(spark, sf):
    out = I.partial_correlation(joined(spark, sf), ["series"], "value", ["qty", "price", "disc"])
    return rounded(rounded(out, "r", digits=7), "t_stat", "p")


@query(
    "lag_corr",
    "T10 W1",
    f"""WITH {JOINED_SQL} SELECT b.series, b.t - a.t AS lag, round(corr(b.value, a.qty), 8) AS r, count(*) AS n
FROM joined b JOIN joined a ON a.series = b.series AND b.t - a.t BETWEEN 1 AND 10 GROUP BY ALL""",
)
def lag_corr(spark, sf):
    return rounded(I.lagged_correlation(joined(spark, sf), ["series"], "t", "value", "qty", range(1, 11)), "r", digits=8)


@query(
    "ccf_best_lag",
    "T11 F1 A19",
    f"""WITH {JOINED_SQL},
dt AS (SELECT series, t, month, value - regr_intercept(value, t) OVER p - regr_slope(value, t) OVER p * t AS dv, qty - regr_intercept(qty, t) OVER p - regr_slope(qty, t) OVER p * t AS dq
  FROM joined WINDOW p AS (PARTITION BY series)),
res AS (SELECT series, t, dv - avg(dv) OVER (PARTITION BY series, month) AS rv, dq - avg(dq) OVER (PARTITION BY series, month) AS rq FROM dt),
c AS (SELECT b.series, b.t - a.t AS lag, corr(b.rv, a.rq) AS r FROM res b JOIN res a ON a.series = b.series AND b.t - a.t BETWEEN 1 AND 24 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC, lag) AS rn FROM c)
SELECT series, lag AS best_lag, round(r, 7) AS best_r FROM k WHERE rn = 1""",
)
def ccf_best_lag(spark, sf):
    j = joined(spark, sf).select("series", "t", "month", "value", "qty")
    y = S.deseasonalised(j, ["series"], "t", "value").select("series", "t", "month", "qty", F.col("residual").alias("rv"))
    both = S.deseasonalised(y, ["series"], "t", "qty").select("series", "t", "rv", F.col("residual").alias("rq"))
    return rounded(I.best_lag(I.lagged_correlation(both, ["series"], "t", "rv", "rq", range(1, 25)), ["series"]), "best_r", digits=7)


@query(
    "autocorrelation",
    "T26",
    f"""WITH {LEVELS_SQL}, d AS (SELECT series, t, value - avg(value) OVER (PARTITION BY series) AS d FROM levels),
v AS (SELECT series, sum(d * d) AS v FROM d GROUP BY series)
SELECT a.series, b.t - a.t AS lag, round(sum(a.d * b.d) / any_value(v), 7) AS acf FROM d a JOIN d b ON a.series = b.series AND b.t - a.t BETWEEN 0 AND 12 JOIN v ON v.series = a.series GROUP BY ALL""",
)
def autocorrelation(spark, sf):
    return rounded(I.autocorrelation(levels(spark, sf), ["series"], "t", "value", 12), "acf", digits=7)


@query(
    "partial_autocorrelation",
    "T26",
    f"""WITH {LEVELS_SQL}, d AS (SELECT series, t, value - avg(value) OVER (PARTITION BY series) AS d FROM levels),
v AS (SELECT series, sum(d * d) AS v FROM d GROUP BY series),
c AS (SELECT a.series, b.t - a.t AS lag, sum(a.d * b.d) / any_value(v) AS r FROM d a JOIN d b ON a.series = b.series AND b.t - a.t BETWEEN 1 AND 2 JOIN v ON v.series = a.series GROUP BY ALL),
w AS (SELECT series, max(CASE WHEN lag = 1 THEN r END) AS r1, max(CASE WHEN lag = 2 THEN r END) AS r2 FROM c GROUP BY series)
SELECT series, 0::BIGINT AS lag, 1.0::DOUBLE AS pacf FROM w UNION ALL SELECT series, 1, round(r1, 7) FROM w UNION ALL SELECT series, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 7) FROM w""",
)
def partial_autocorrelation(spark, sf):
    acf = I.autocorrelation(levels(spark, sf), ["series"], "t", "value", 2)
    return rounded(I.partial_autocorrelation(acf, ["series"]), "pacf", digits=7)


@query(
    "partial_autocorrelation_12",
    "T26",
    f"""WITH RECURSIVE {LEVELS_SQL}, d AS (SELECT series, t, value - avg(value) OVER (PARTITION BY series) AS d FROM levels),
v AS (SELECT series, sum(d * d) AS v FROM d GROUP BY series),
c AS (SELECT a.series, b.t - a.t AS lag, sum(a.d * b.d) / any_value(v) AS r FROM d a JOIN d b ON a.series = b.series AND b.t - a.t BETWEEN 1 AND 12 JOIN v ON v.series = a.series GROUP BY ALL),
w AS (SELECT series, list(r ORDER BY lag) AS r FROM c GROUP BY series),
pl AS (SELECT series, 1 AS k, [r[1]] AS phi, r[1] AS pacf, r FROM w
  UNION ALL SELECT series, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - nxt * phi[k + 1 - j]), [nxt]), nxt, r
  FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS nxt FROM pl WHERE k < 12))
SELECT series, 0::BIGINT AS lag, 1.0::DOUBLE AS pacf FROM w UNION ALL SELECT series, k, round(pacf, 7) FROM pl""",
)
def partial_autocorrelation_12(spark, sf):
    acf = I.autocorrelation(levels(spark, sf), ["series"], "t", "value", 12)
    return rounded(I.partial_autocorrelation(acf, ["series"]), "pacf", digits=7)


# ------------------------------------------------------------------ two-sample tests

PERIOD_SQL = "CASE WHEN year(o_orderdate) IN (1995, 1996, 1997) THEN 'Low' WHEN year(o_orderdate) IN (1999, 2000, 2001) THEN 'High' END"
WELCH_SQL = f"""facts AS (SELECT o_orderpriority AS series, {PERIOD_SQL} AS period, o_totalprice AS x FROM orders),
m AS (SELECT series, period, avg(x) AS mean, var_samp(x) AS var, CAST(count(x) AS DOUBLE) AS n FROM facts WHERE period IS NOT NULL GROUP BY ALL),
p AS (SELECT l.series, l.mean AS ml, h.mean AS mh, l.var / l.n AS vl, h.var / h.n AS vh, l.n AS nl, h.n AS nh FROM m l JOIN m h ON l.series = h.series AND l.period = 'Low' AND h.period = 'High'),
w AS (SELECT *, (ml - mh) / sqrt(vl + vh) AS t_stat, (vl + vh) * (vl + vh) / (vl * vl / (nl - 1) + vh * vh / (nh - 1)) AS dof FROM p)"""


def period_facts(spark, sf):
    year = F.year("o_orderdate")
    period = F.when(year.isin(1995, 1996, 1997), "Low").when(year.isin(1999, 2000, 2001), "High")
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), period.alias("period"), F.col("o_totalprice").alias("x"))


@query(
    "welch_t",
    "T12",
    f"WITH {WELCH_SQL} SELECT series, round(ml, 4) AS low_mean, round(mh, 4) AS high_mean, round(t_stat, 7) AS t_stat, round(dof, 4) AS dof, round({t_p('t_stat', 'dof')}, 7) AS t_p FROM w",
)
def welch_t(spark, sf):
    w = I.welch(period_facts(spark, sf), ["series"], "period", "Low", "High", "x").select("series", "low_mean", "high_mean", "t_stat", "dof", "t_p")
    return rounded(rounded(w, "low_mean", "high_mean", "dof", digits=4), "t_stat", "t_p", digits=7)


MWU_SQL = f"""facts2 AS (SELECT * FROM facts WHERE period IS NOT NULL),
rk AS (SELECT series, period, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2.0 AS rk FROM facts2),
ti AS (SELECT series, sum(c * c * c - c) AS ties FROM (SELECT series, x, CAST(count(*) AS DOUBLE) AS c FROM facts2 GROUP BY ALL) GROUP BY series),
ru AS (SELECT series, CAST(count_if(period = 'Low') AS DOUBLE) AS n1, CAST(count_if(period = 'High') AS DOUBLE) AS n2, sum(CASE WHEN period = 'Low' THEN CAST(rk AS DOUBLE) END) AS r1 FROM rk GROUP BY series),
us AS (SELECT ru.series, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM ru JOIN ti USING (series)),
uz AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS uz FROM us)"""


@query(
    "mann_whitney_u",
    "T13 W16",
    f"WITH {WELCH_SQL}, {MWU_SQL} SELECT series, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(u AS DOUBLE) AS u_stat, round(least(1.0, {normal_p('uz')}), 7) AS u_p FROM uz",
)
def mann_whitney_u(spark, sf):
    return rounded(I.mann_whitney(period_facts(spark, sf), ["series"], "period", "Low", "High", "x"), "u_p", digits=7)


@query(
    "composite_comparison",
    "T14 P25",
    f"""WITH {WELCH_SQL}, {MWU_SQL}, mm AS (SELECT series, {', '.join(f"{f}(CASE WHEN period = '{p}' THEN x END) AS {p.lower()}_{n}" for p in ('Low', 'High') for f, n in (('stddev_samp', 'std'), ('min', 'min'), ('max', 'max'), ('count', 'n')))} FROM facts GROUP BY series)
SELECT series, round(ml, 4) AS low_mean, round(mh, 4) AS high_mean, round(low_std, 4) AS low_std, round(high_std, 4) AS high_std, low_min, high_min, low_max, high_max, low_n, high_n,
       round(mh - ml, 4) AS diff, round((mh - ml) / ml * 100, 5) AS diff_pct, round({t_p('t_stat', 'dof')}, 7) AS t_p, CAST(u AS DOUBLE) AS u_stat, round(least(1.0, {normal_p('uz')}), 7) AS u_p, {t_p('t_stat', 'dof')} < 0.05 AS significant
FROM w JOIN uz USING (series) JOIN mm USING (series)""",
)
def composite_comparison(spark, sf):
    c = I.compare_periods(period_facts(spark, sf), ["series"], "period", "Low", "High", "x").drop("t_stat", "dof")
    return rounded(rounded(rounded(c, "low_mean", "high_mean", "low_std", "high_std", "diff", digits=4), "diff_pct", digits=5), "t_p", "u_p", digits=7)


@query(
    "bh_adjust",
    "T21",
    f"""WITH {JOINED_SQL}, c AS (SELECT b.series, b.t - a.t AS lag, corr(b.value, a.qty) AS r, count(*) AS n FROM joined b JOIN joined a ON a.series = b.series AND b.t - a.t BETWEEN 1 AND 6 GROUP BY ALL),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t_stat, CAST(n - 2 AS DOUBLE) AS dof FROM c),
p AS (SELECT series, lag, {t_p('t_stat', 'dof')} AS p FROM t),
q AS (SELECT *, p * count(*) OVER (PARTITION BY series) / row_number() OVER (PARTITION BY series ORDER BY p) AS raw FROM p)
SELECT series, lag, round(p, 7) AS p, round(least(1.0, min(raw) OVER (PARTITION BY series ORDER BY p DESC)), 7) AS p_adjusted FROM q""",
)
def bh_adjust(spark, sf):
    c = I.lagged_correlation(joined(spark, sf), ["series"], "t", "value", "qty", range(1, 7))
    _, p = I.correlation_p(F.col("r"), F.col("n"))
    return rounded(I.benjamini_hochberg(c.withColumn("p", p), ["series"], "p").select("series", "lag", "p", "p_adjusted"), "p", "p_adjusted", digits=7)


# ------------------------------------------------------------------ extremes, metrics


@query(
    "extremes_strict",
    "T23 A20",
    f"""WITH {LEVELS_SQL}, l AS (SELECT series, quantile_cont(value, 0.9) AS hi, quantile_cont(value, 0.1) AS lo FROM levels GROUP BY series)
SELECT series, CAST(count_if(value > hi) AS BIGINT) AS n_high, CAST(count_if(value < lo) AS BIGINT) AS n_low, count(*) AS n, round(100.0 * (count_if(value > hi) + count_if(value < lo)) / count(*), 6)::DOUBLE AS frequency_pct
FROM levels JOIN l USING (series) GROUP BY series""",
)
def extremes_strict(spark, sf):
    return rounded(I.extreme_counts(levels(spark, sf), ["series"], "value"), "frequency_pct")


@query(
    "extremes_inclusive",
    "T23",
    f"""WITH {LEVELS_SQL}, a AS (SELECT series, year, avg(value) AS value FROM levels GROUP BY ALL),
l AS (SELECT series, quantile_cont(value, 0.9) AS hi, quantile_cont(value, 0.1) AS lo FROM a GROUP BY series)
SELECT series, year, value >= hi AS is_high, value <= lo AS is_low FROM a JOIN l USING (series) WHERE value >= hi OR value <= lo""",
)
def extremes_inclusive(spark, sf):
    annual = R.annual_mean(levels(spark, sf), "value", ["series"])
    e = I.extremes(annual, ["series"], "value", inclusive=True)
    return e.where(F.col("is_high") | F.col("is_low")).select("series", "year", "is_high", "is_low")


@query(
    "fit_metrics",
    "T31 M33",
    f"""WITH {LEVELS_SQL}, f AS (SELECT *, regr_intercept(value, t) OVER p + regr_slope(value, t) OVER p * t AS fit FROM levels WINDOW p AS (PARTITION BY series))
SELECT series, round(1 - sum((value - fit) * (value - fit)) / regr_syy(value, value), 7) AS r2, round(sqrt(avg((value - fit) * (value - fit))), 5) AS rmse, round(avg(abs(value - fit)), 5) AS mae,
       round(100 * avg(abs((value - fit) / value)), 6) AS mape, count(*) AS n FROM f GROUP BY series""",
)
def fit_metrics(spark, sf):
    d = S.detrended(levels(spark, sf), ["series"], "t", "value")
    return rounded(rounded(rounded(I.metrics(d, ["series"], "value", "trend"), "r2", digits=7), "rmse", "mae", digits=5), "mape")


@query(
    "normal_quantile_plot",
    "T26 K11",
    f"""WITH {LEVELS_SQL}, q AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value, t) AS i, count(*) OVER (PARTITION BY series) AS n FROM levels)
SELECT series, i, value, round((i - 0.5) / n, 9) AS prob FROM q""",
)
def normal_quantile_plot(spark, sf):
    from pyspark.sql import Window

    s = levels(spark, sf).withColumn("i", F.row_number().over(S.by(["series"], ["value", "t"])).cast("long"))
    prob = (F.col("i") - 0.5) / F.count(F.lit(1)).over(Window.partitionBy("series"))
    return s.select("series", "i", "value", F.round(prob, 9).alias("prob"))
