"""Relational core: projection, filters, joins, aggregation, pivots and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import blocked as B
from tidemark.operators import relational as R
from tidemark.operators import series as S
from tidemark.plans.base import (
    FLUX_SQL,
    JOINED_SQL,
    LEVELS_SQL,
    PREDICTORS_SQL,
    SIDES,
    flux,
    joined,
    levels,
    predictors,
    query,
    r,
    rounded,
    table,
)

# ------------------------------------------------------------------ slice 0: the whole path


@query(
    "annual_trend_forecast",
    "P1 A1 A2 T6 M1 T29 A23 S16",
    f"""WITH {LEVELS_SQL},
annual AS (SELECT series, year, avg(value) AS value FROM levels GROUP BY ALL),
fit AS (SELECT series, regr_slope(value, year) AS slope, regr_intercept(value, year) AS icept, max(year) AS last_year FROM annual GROUP BY series),
band AS (SELECT a.series, stddev_pop(a.value - (f.icept + f.slope * a.year)) AS sd FROM annual a JOIN fit f USING (series) GROUP BY a.series)
SELECT f.series, f.last_year + h.h AS year, round(f.icept + f.slope * (f.last_year + h.h), 4) AS forecast,
       round(f.icept + f.slope * (f.last_year + h.h) - 1.96 * b.sd, 4) AS lower, round(f.icept + f.slope * (f.last_year + h.h) + 1.96 * b.sd, 4) AS upper
FROM fit f JOIN band b USING (series) CROSS JOIN (SELECT unnest(range(1, 6)) AS h) h""",
)
def annual_trend_forecast(spark, sf):
    from tidemark.operators import trend

    annual = R.annual_mean(levels(spark, sf), "value", ["series"])
    return rounded(trend.forecast_constant_band(annual, ["series"], "year", "value", 5), "forecast", "lower", "upper", digits=4)


# ------------------------------------------------------------------ calendar aggregation


@query("monthly_mean", "P16 A1", f"WITH {LEVELS_SQL} SELECT series, year, month, date, value, n_obs FROM levels")
def monthly_mean(spark, sf):
    return levels(spark, sf).drop("t")


@query("annual_mean_of_months", "A2", f"WITH {LEVELS_SQL} SELECT series, year, round(avg(value), 5) AS value FROM levels GROUP BY ALL")
def annual_mean_of_months(spark, sf):
    return rounded(R.annual_mean(levels(spark, sf), "value", ["series"]), "value", digits=5)


@query(
    "annual_mean_of_obs",
    "A2",
    """SELECT o_orderpriority AS series, year(o_orderdate) AS year,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(o_totalprice) AS value FROM orders GROUP BY ALL""",
)
def annual_mean_of_obs(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").cast("long").alias("year")).agg(
        R.exact_mean("o_totalprice", 100).alias("value")
    )


@query(
    "annual_mean_all_numeric",
    "A3 P4 P5",
    f"""WITH {JOINED_SQL} SELECT year, round(avg(value), 5) AS value, round(avg(qty), 5) AS qty, round(avg(price), 5) AS price,
       round(avg(disc), 5) AS disc FROM joined GROUP BY year""",
)
def annual_mean_all_numeric(spark, sf):
    means = R.mean_all_numeric(joined(spark, sf), ["year"], drop=["month", "t", "n_obs"])
    return rounded(means, "value", "qty", "price", "disc", digits=5)


@query("climatology", "A4", f"WITH {LEVELS_SQL} SELECT series, month, round(avg(value), 5) AS value FROM levels GROUP BY ALL")
def climatology(spark, sf):
    return rounded(levels(spark, sf).groupBy("series", "month").agg(F.avg("value").alias("value")), "value", digits=5)


DJF_SQL = "CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Spring' WHEN month IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"


@query(
    "season_djf",
    "P20 P22 A5",
    f"WITH {LEVELS_SQL} SELECT series, {DJF_SQL} AS season, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std FROM levels GROUP BY ALL",
)
def season_djf(spark, sf):
    s = levels(spark, sf).withColumn("season", C.season_djf("month"))
    return rounded(s.groupBy("series", "season").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")), "mean", "std", digits=5)


@query(
    "season_quarter",
    "P21 A5",
    f"""WITH {LEVELS_SQL} SELECT series, CASE WHEN month <= 3 THEN 'Winter' WHEN month <= 6 THEN 'Spring' WHEN month <= 9 THEN 'Summer' ELSE 'Autumn' END AS season,
       round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std FROM levels GROUP BY ALL""",
)
def season_quarter(spark, sf):
    s = levels(spark, sf).withColumn("season", C.season_quarter("month"))
    return rounded(s.groupBy("series", "season").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")), "mean", "std", digits=5)


SEASONS = ("Winter", "Spring", "Summer", "Autumn")


@query(
    "year_season_unstack",
    "A6",
    f"""WITH {LEVELS_SQL} SELECT year, """
    + ", ".join(f"round(avg(CASE WHEN {DJF_SQL} = '{s}' THEN value END), 5) AS {s}" for s in SEASONS)
    + " FROM levels GROUP BY year",
)
def year_season_unstack(spark, sf):
    s = levels(spark, sf).withColumn("season", C.season_djf("month"))
    return rounded(R.pivot_mean(s, ["year"], "season", SEASONS, "value"), *SEASONS, digits=5)


@query(
    "decade_month_pivot",
    "A7 P23",
    f"""WITH {LEVELS_SQL} SELECT CAST(floor(year / 10) * 10 AS BIGINT) AS decade, """
    + ", ".join(f"round(avg(CASE WHEN month = {m} THEN value END), 5) AS m{m}" for m in range(1, 13))
    + " FROM levels GROUP BY 1",
)
def decade_month_pivot(spark, sf):
    s = levels(spark, sf).withColumn("decade", C.decade("year"))
    return rounded(R.pivot_mean(s, ["decade"], "month", range(1, 13), "value", "m"), *[f"m{m}" for m in range(1, 13)], digits=5)


@query(
    "year_month_heatmap",
    "A8 K11",
    f"WITH {LEVELS_SQL} SELECT series, year, "
    + ", ".join(f"avg(CASE WHEN month = {m} THEN value END) AS m{m}" for m in range(1, 13))
    + " FROM levels GROUP BY ALL",
)
def year_month_heatmap(spark, sf):
    return R.pivot_mean(levels(spark, sf), ["series", "year"], "month", range(1, 13), "value", "m")


# ------------------------------------------------------------------ flux tables


@query("flux_monthly", "J1 A12", f"WITH {FLUX_SQL} SELECT * FROM flux")
def flux_monthly(spark, sf):
    return flux(spark, sf)


FLOWS = [(side, flow) for flow in ("inflow", "outflow") for side in SIDES]
FLUX_WIDE_SQL = (
    FLUX_SQL
    + ",\nwide AS (SELECT sector, year, month, "
    + ", ".join(f"max(CASE WHEN side = '{s}' THEN {f} END) AS {s}_{f}" for s, f in FLOWS)
    + " FROM flux GROUP BY ALL)"
)


@query("flux_long_to_wide", "A9 D12", f"WITH {FLUX_WIDE_SQL} SELECT * FROM wide")
def flux_long_to_wide(spark, sf):
    return R.flux_wide(flux(spark, sf), ["sector", "year", "month"], "side", SIDES)


@query(
    "flux_melt",
    "A10",
    f"WITH {FLUX_SQL} SELECT sector, side, year, month, 'inflow' AS flow, inflow AS value FROM flux UNION ALL SELECT sector, side, year, month, 'outflow', outflow FROM flux",
)
def flux_melt(spark, sf):
    return R.flux_long(flux(spark, sf), ["sector", "side", "year", "month"], ["inflow", "outflow"])


@query(
    "net_flux_row_sum",
    "P3 P6 G19",
    f"""WITH {FLUX_WIDE_SQL}, totals AS (SELECT sector, year, month, """
    + ", ".join(f"{' + '.join(f'coalesce({s}_{f}, 0)' for s in SIDES)} AS total_{f}" for f in ("inflow", "outflow"))
    + """ FROM wide)
SELECT sector, year, month, round(total_inflow, 8) AS total_inflow, round(total_outflow, 8) AS total_outflow,
       round(total_inflow - total_outflow, 8) AS net, round(abs(total_inflow - total_outflow) / (total_inflow + total_outflow + 1e-10) * 100, 5) AS error_pct FROM totals""",
)
def net_flux_row_sum(spark, sf):
    wide = flux_long_to_wide(spark, sf)
    wide = wide.withColumns({f"total_{f}": C.row_sum([f"{s}_{f}" for s in SIDES]) for f in ("inflow", "outflow")})
    net = F.col("total_inflow") - F.col("total_outflow")
    wide = wide.withColumns({"net": net, "error_pct": F.abs(net) / (F.col("total_inflow") + F.col("total_outflow") + 1e-10) * 100})
    wide = wide.select("sector", "year", "month", "total_inflow", "total_outflow", "net", r("error_pct", 5).alias("error_pct"))
    return rounded(wide, "total_inflow", "total_outflow", "net", digits=8)


@query(
    "row_mean_ensemble",
    "P7 M35",
    f"WITH {FLUX_WIDE_SQL} SELECT sector, year, month, round(("
    + " + ".join(f"coalesce({s}_inflow, 0)" for s in SIDES)
    + ") / nullif("
    + " + ".join(f"CASE WHEN {s}_inflow IS NULL THEN 0 ELSE 1 END" for s in SIDES)
    + ", 0), 5) AS ensemble FROM wide",
)
def row_mean_ensemble(spark, sf):
    wide = flux_long_to_wide(spark, sf)
    return wide.select("sector", "year", "month", r(C.row_mean([f"{s}_inflow" for s in SIDES]), 5).alias("ensemble"))


@query(
    "strict_annual_sum",
    "A12",
    f"WITH {FLUX_SQL} SELECT sector, side, year, round(CASE WHEN count(*) = count(outflow) THEN sum(outflow) END, 5) AS total, count(outflow) AS present FROM flux GROUP BY ALL",
)
def strict_annual_sum(spark, sf):
    return flux(spark, sf).groupBy("sector", "side", "year").agg(r(C.strict_sum("outflow"), 5).alias("total"), F.count("outflow").alias("present"))


@query(
    "basic_stats",
    "A12 A13",
    f"""WITH {FLUX_SQL} SELECT sector, side, round(avg(inflow), 5) AS mean, round(stddev_samp(inflow), 5) AS std, round(stddev_pop(inflow), 5) AS std_pop,
       min(inflow) AS min, max(inflow) AS max, count(inflow) AS count FROM flux GROUP BY ALL""",
)
def basic_stats(spark, sf):
    stats = flux(spark, sf).groupBy("sector", "side").agg(
        F.avg("inflow").alias("mean"),
        F.stddev_samp("inflow").alias("std"),
        F.stddev_pop("inflow").alias("std_pop"),
        F.min("inflow").alias("min"),
        F.max("inflow").alias("max"),
        F.count("inflow").alias("count"),
    )
    return rounded(stats, "mean", "std", "std_pop", digits=5)


@query(
    "describe_exact",
    "A11 A20",
    f"""WITH {FLUX_SQL} SELECT sector, side, count(inflow) AS count, round(avg(inflow), 5) AS mean, round(stddev_samp(inflow), 5) AS std, min(inflow) AS min,
       round(quantile_cont(inflow, 0.25), 6) AS p25, round(quantile_cont(inflow, 0.5), 6) AS p50, round(quantile_cont(inflow, 0.75), 6) AS p75, max(inflow) AS max
       FROM flux GROUP BY ALL""",
)
def describe_exact(spark, sf):
    d = R.describe_exact(flux(spark, sf), "inflow", ["sector", "side"])
    return rounded(rounded(d, "mean", "std", digits=5), "p25", "p50", "p75")


@query(
    "fact_quantiles",
    "A20 A11",
    " UNION ALL ".join(
        f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(l_extendedprice, {p}), 6) AS quantile FROM lineitem GROUP BY l_returnflag"
        for p in (0.1, 0.5, 0.9)
    ),
)
def fact_quantiles(spark, sf):
    """Exact quantiles straight over the facts, where a group may hold any share of the rows."""
    q = B.exact_quantiles(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9])
    return rounded(q, "quantile")


# ------------------------------------------------------------------ joins


@query(
    "outer_join_chain",
    "J5 J6 A25",
    """WITH a AS (SELECT year(o_orderdate) AS year, count(*) AS n_orders FROM orders GROUP BY 1),
b AS (SELECT year(l_shipdate) AS year, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1),
c AS (SELECT year(ts) AS year, count(*) AS n_events FROM events GROUP BY 1)
SELECT year, n_orders, qty, n_events FROM a FULL JOIN b USING (year) FULL JOIN c USING (year)""",
)
def outer_join_chain(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    c = table(spark, sf, "events").groupBy(F.year("ts").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n_events"))
    return R.outer_chain([a, b, c], ["year"])


@query("obs_to_monthly_index", "J2 J3 J1", f"WITH {JOINED_SQL} SELECT series, date, t, value, qty, price, disc FROM joined")
def obs_to_monthly_index(spark, sf):
    return joined(spark, sf).select("series", "date", "t", "value", "qty", "price", "disc")


@query(
    "left_join_fill_mean",
    "J4 P14",
    f"""WITH {LEVELS_SQL}, {PREDICTORS_SQL}, j AS (
  SELECT l.series, l.date, l.value, p.qty FROM levels l LEFT JOIN (SELECT * FROM predictors WHERE month(date) <> 7) p ON l.date = p.date)
SELECT series, date, value, round(coalesce(qty, avg(qty) OVER (PARTITION BY series), 0), 5) AS qty FROM j""",
)
def left_join_fill_mean(spark, sf):
    gappy = predictors(spark, sf).select("date", "qty").where(F.month("date") != 7)
    j = R.left_chain(levels(spark, sf).select("series", "date", "value"), [gappy], ["date"])
    return rounded(R.fill_with_mean(j, ["qty"], ["series"]), "qty", digits=5)


@query(
    "semi_join_period",
    "J7 P10 D18",
    f"WITH {LEVELS_SQL} SELECT series, date, value FROM levels WHERE year IN (1996, 1997, 2000)",
)
def semi_join_period(spark, sf):
    wanted = R.period_rows(spark, {"picked": (1996, 1997, 2000)}).select("year")
    return levels(spark, sf).join(F.broadcast(wanted), "year", "left_semi").select("series", "date", "value")


@query(
    "anti_resume",
    "J8 J9 S16",
    f"""WITH {FLUX_SQL}, keys AS (SELECT DISTINCT sector, side FROM flux),
tasks AS (SELECT sector, side, y AS year, m AS month FROM keys, range(1995, 2004) a(y), range(1, 13) b(m))
SELECT sector, side, year, month FROM tasks ANTI JOIN flux USING (sector, side, year, month)""",
)
def anti_resume(spark, sf):
    done = flux(spark, sf).select("sector", "side", "year", "month")
    tasks = S.calendar_grid(done.select("sector", "side").distinct(), 1995, 2003)
    return R.pending(tasks, done, ["sector", "side", "year", "month"])


@query(
    "upsert_results",
    "J17 A23",
    f"""WITH {LEVELS_SQL}, fresh AS (SELECT series, date, value * 2 AS value FROM levels WHERE year >= 2000)
SELECT series, date, value FROM fresh UNION ALL SELECT series, date, value FROM levels ANTI JOIN fresh USING (series, date)""",
)
def upsert_results(spark, sf):
    old = levels(spark, sf).select("series", "date", "value")
    fresh = old.where(F.year("date") >= 2000).withColumn("value", F.col("value") * 2)
    return R.upsert(old, fresh, ["series", "date"])


PERIODS = {"Low": (1995, 1996, 1997), "High": (1999, 2000, 2001), "First": tuple(range(1995, 1999)), "Last": tuple(range(1998, 2002))}
PERIODS_SQL = "periods AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {y})" for p, ys in PERIODS.items() for y in ys) + ") v(period, year))"


@query(
    "period_composite",
    "A17 D18 J7",
    f"""WITH {FLUX_SQL}, {PERIODS_SQL} SELECT sector, period, round(avg(inflow), 5) AS inflow, round(avg(outflow), 5) AS outflow, count(*) AS n
FROM flux JOIN periods USING (year) GROUP BY ALL""",
)
def period_composite(spark, sf):
    return rounded(R.composite(flux(spark, sf), R.period_rows(spark, PERIODS), ["inflow", "outflow"], ["sector"]), "inflow", "outflow", digits=5)


# ------------------------------------------------------------------ projection, predicates, cleaning


@query(
    "projection_cleaning",
    "P1 P2 P3 P8 P9 P11 P16 P17 P18 P24 P25",
    f"""WITH {JOINED_SQL} SELECT series, date, year, qty AS quantity, year / 10.0 AS year_scaled, round(value / nullif(qty, 0), 5) AS ratio,
       CASE WHEN year >= 2001 THEN 8.0 WHEN year >= 1999 THEN 4.0 WHEN year >= 1997 THEN 2.0 ELSE 1.0 END::DOUBLE AS step_weight,
       row_number() OVER (PARTITION BY series ORDER BY date) AS recency, disc < 5.0 AS low_disc, round((value - qty) / abs(qty) * 100, 5) AS pct
FROM joined WHERE year BETWEEN 1996 AND 2000 AND value IS NOT NULL AND qty IS NOT NULL""",
)
def projection_cleaning(spark, sf):
    j = joined(spark, sf).where(F.col("year").between(1996, 2000)).na.drop(subset=["value", "qty"]).withColumnRenamed("qty", "quantity")
    j = S.with_index(j, ["series"], "date", "recency")
    return j.select(
        "series",
        "date",
        "year",
        "quantity",
        (F.col("year") / 10.0).alias("year_scaled"),
        r(C.safe_ratio("value", "quantity"), 5).alias("ratio"),
        C.step_weight("year", ((2001, 8.0), (1999, 4.0), (1997, 2.0))).alias("step_weight"),
        (F.col("recency") + 1).alias("recency"),
        C.significant("disc", 5.0).alias("low_disc"),
        r(C.pct_change("value", "quantity"), 5).alias("pct"),
    )


@query(
    "coerce_numeric",
    "P16 P26",
    """SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS n_numeric,
       CAST(sum(try_cast(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""",
)
def coerce_numeric(spark, sf):
    e = table(spark, sf, "events").select("event_type", "props")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.get_json_object("props", "$.k").try_cast("double")).alias("n_numeric"),
        F.sum(F.regexp_replace("props", "[^0-9]", "").try_cast("bigint")).alias("total"),
    )


@query(
    "qc_filter",
    "P19 P10",
    """SELECT l_returnflag, l_linestatus, count(*) AS flagged, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM lineitem WHERE abs(l_quantity - 25) > 20 OR abs(l_discount - 0.05) > 0.045 GROUP BY ALL""",
)
def qc_filter(spark, sf):
    bad = (F.abs(F.col("l_quantity") - 25) > 20) | (F.abs(F.col("l_discount") - 0.05) > 0.045)
    items = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice").where(bad)
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("flagged"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    )


@query(
    "distinct_coordinates",
    "P12 P13 A18",
    """SELECT l_partkey % 24 AS iy, l_suppkey % 20 AS ix, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY ALL""",
)
def distinct_coordinates(spark, sf):
    points = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 24).alias("iy"), (F.col("l_suppkey") % 20).alias("ix"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )
    return R.first_distinct(points, ["iy", "ix"], "seq")


@query(
    "distinct_per_key",
    "A18 A24",
    """SELECT c_mktsegment AS side, count(DISTINCT c_nationkey) AS n_nations, list_sort(list(DISTINCT c_nationkey)) AS nations FROM customer GROUP BY 1""",
)
def distinct_per_key(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("side"), "c_nationkey")
    nations = F.array_sort(F.collect_set("c_nationkey"))  # at most one entry per nation
    return c.groupBy("side").agg(F.count_distinct("c_nationkey").alias("n_nations"), nations.alias("nations"))


GAPS_SQL = "gaps AS (SELECT series, date, t, CASE WHEN t < 2 OR t % 7 IN (3, 4) OR t > max(t) OVER (PARTITION BY series) - 2 THEN NULL ELSE value END AS value FROM levels)"


def with_gaps(spark, sf):
    last = F.max("t").over(Window.partitionBy("series"))
    gap = (F.col("t") < 2) | (F.col("t") % 7).isin(3, 4) | (F.col("t") > last - 2)
    return levels(spark, sf).select("series", "date", "t", F.when(~gap, F.col("value")).alias("value"))


INTERP_SQL = """a AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series ORDER BY t) AS lo,
    min(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM {src})
SELECT a.series, a.t, round(coalesce(a.value, l.value + (h.value - l.value) * (a.t - a.lo) / (a.hi - a.lo), l.value, h.value), 6) AS value
FROM a LEFT JOIN {src} l ON a.series = l.series AND a.lo = l.t LEFT JOIN {src} h ON a.series = h.series AND a.hi = h.t"""


@query("interp_linear", "P15", f"WITH {LEVELS_SQL}, {GAPS_SQL}, " + INTERP_SQL.format(src="gaps"))
def interp_linear(spark, sf):
    filled = S.interpolate_linear(with_gaps(spark, sf), ["series"], "t", ["value"])
    return rounded(filled.select("series", "t", "value"), "value")


@query(
    "topk_abs",
    "A25 A26",
    f"""WITH {LEVELS_SQL}, a AS (SELECT series, date, value - avg(value) OVER (PARTITION BY series) AS dev FROM levels)
SELECT series, date, round(dev, 5) AS dev FROM a ORDER BY abs(dev) DESC, series, date LIMIT 15""",
)
def topk_abs(spark, sf):
    dev = levels(spark, sf).select("series", "date", S.anomaly("value", ["series"], []).alias("dev"))
    return rounded(R.top_abs(dev, "dev", 15, "series", "date"), "dev", digits=5)


@query(
    "first_last_extremes",
    "A19 A27",
    f"""WITH {LEVELS_SQL} SELECT series, arg_min(value, date) AS first_value, arg_max(value, date) AS last_value,
       (SELECT t FROM levels i WHERE i.series = o.series ORDER BY value DESC, t LIMIT 1) AS argmax_t,
       (SELECT t FROM levels i WHERE i.series = o.series ORDER BY value, t LIMIT 1) AS argmin_t
FROM levels o GROUP BY series""",
)
def first_last_extremes(spark, sf):
    return (
        levels(spark, sf)
        .groupBy("series")
        .agg(
            F.min_by("value", "date").alias("first_value"),
            F.max_by("value", "date").alias("last_value"),
            R.arg_extreme("value", "t")["t"].alias("argmax_t"),
            R.arg_extreme("value", "t", largest=False)["t"].alias("argmin_t"),
        )
    )


@query(
    "vertical_concat",
    "A23",
    """SELECT year(o_orderdate) AS year, count(*) AS n, 'orders' AS source, CAST(NULL AS DOUBLE) AS qty FROM orders GROUP BY 1
UNION ALL SELECT year(l_shipdate), count(*), 'lineitem', CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) FROM lineitem GROUP BY 1""",
)
def vertical_concat(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("orders"))
    b = (
        table(spark, sf, "lineitem")
        .groupBy(F.year("l_shipdate").cast("long").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("qty"))
        .withColumn("source", F.lit("lineitem"))
    )
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "month_total_from_mean",
    "A16",
    f"WITH {LEVELS_SQL} SELECT series, date, value * day(last_day(date)) AS month_total FROM levels",
)
def month_total_from_mean(spark, sf):
    return levels(spark, sf).select("series", "date", (F.col("value") * C.days_in_month("date")).alias("month_total"))


@query(
    "report_rows",
    "K7 K8",
    f"""WITH {LEVELS_SQL} SELECT series, 'n=' || count(*) || ' first=' || strftime(min(date), '%Y-%m') || ' last=' || strftime(max(date), '%Y-%m') AS line,
       md5(series) AS cache_key FROM levels GROUP BY series""",
)
def report_rows(spark, sf):
    text = F.format_string("n=%d first=%s last=%s", F.count(F.lit(1)), F.date_format(F.min("date"), "yyyy-MM"), F.date_format(F.max("date"), "yyyy-MM"))
    return levels(spark, sf).groupBy("series").agg(text.alias("line")).withColumn("cache_key", F.md5(F.col("series").cast("binary")))
