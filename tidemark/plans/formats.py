"""Text parsing, file-name fields and report formatting as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import trend as T
from tidemark.plans.base import LEVELS_SQL, levels, query, table
from tidemark.session import cut_lineage, ensure_checkpoint_dir
from tidemark.sources import files, sinks, stores, text


@query(
    "filename_fields",
    "S13 S14",
    """WITH p AS (SELECT DISTINCT 'store/p' || strftime(o_orderdate, '%Y%m') || '.tif' AS path FROM orders UNION SELECT DISTINCT 'store/' || n_name || '_East_inflow.txt' FROM nation)
SELECT path, try_cast(nullif(regexp_extract(path, 'p(\\d{4})(\\d{2})\\.tif', 1), '') AS BIGINT) AS year, try_cast(nullif(regexp_extract(path, 'p(\\d{4})(\\d{2})\\.tif', 2), '') AS BIGINT) AS month FROM p""",
)
def filename_fields(spark, sf):
    rasters = table(spark, sf, "orders").select(F.concat(F.lit("store/p"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".tif")).alias("path")).distinct()
    others = table(spark, sf, "nation").select(F.concat(F.lit("store/"), "n_name", F.lit("_East_inflow.txt")).alias("path"))
    return files.with_name_fields(rasters.union(others.distinct()), "raster_month")


@query(
    "whitespace_fields",
    "S6",
    """WITH l AS (SELECT o_orderkey, '  ' || o_orderkey || '   ' || o_orderstatus || ' ' || strftime(o_orderdate, '%Y %m') || ' ' AS line FROM orders)
SELECT o_orderkey, split_part(regexp_replace(trim(line), '\\s+', ' ', 'g'), ' ', 1) AS key, split_part(regexp_replace(trim(line), '\\s+', ' ', 'g'), ' ', 2) AS status,
       CAST(split_part(regexp_replace(trim(line), '\\s+', ' ', 'g'), ' ', 3) AS BIGINT) AS year, CAST(split_part(regexp_replace(trim(line), '\\s+', ' ', 'g'), ' ', 4) AS BIGINT) AS month FROM l""",
)
def whitespace_fields(spark, sf):
    line = F.concat(F.lit("  "), "o_orderkey", F.lit("   "), "o_orderstatus", F.lit(" "), F.date_format("o_orderdate", "yyyy MM"), F.lit(" "))
    rows = table(spark, sf, "orders").select("o_orderkey", line.alias("line"))
    fields = text.split_whitespace("line", ["key", "status", "year", "month"])
    return text.coerce(rows.select("o_orderkey", *fields), {"year": "bigint", "month": "bigint"})


@query(
    "fused_column_split",
    "P16",
    """SELECT event_id, event_type AS kind, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS BIGINT) AS user FROM events""",
)
def fused_column_split(spark, sf):
    user = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
    fused = table(spark, sf, "events").select("event_id", F.concat_ws(";", "event_type", user).alias("row"))
    return text.coerce(text.split_fused(fused, "row", ["kind", "user"]), {"user": "bigint"})


@query(
    "nan_as_missing",
    "P11",
    """SELECT l_returnflag, count(CASE WHEN l_linenumber % 3 <> 0 THEN 1 END) AS present, count(*) AS n, CAST(max(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END) AS DOUBLE) AS top FROM lineitem GROUP BY 1""",
)
def nan_as_missing(spark, sf):
    holed = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows = text.missing_to_null(table(spark, sf, "lineitem").select("l_returnflag", holed.alias("q")))
    return rows.groupBy("l_returnflag").agg(F.count("q").alias("present"), F.count(F.lit(1)).alias("n"), F.max("q").alias("top"))


@query(
    "trend_report_table",
    "K7 K8 P24",
    f"""WITH {LEVELS_SQL}, f AS (SELECT series, regr_slope(value, t) AS slope, avg(value) AS mean FROM levels GROUP BY series)
SELECT series, replace(series, '_', '\\_') || ' & ' || printf('%.3f', slope) || ' & ' || printf('%.3f', mean) || ' \\\\' AS line FROM f""",
)
def trend_report_table(spark, sf):
    fit = T.ols(levels(spark, sf), ["series"], "t", "value").join(levels(spark, sf).groupBy("series").agg(F.avg("value").alias("mean")), "series")
    return sinks.latex_rows(fit.select("series", "slope", "mean"), ["series"], ["slope", "mean"], digits=3)


@query(
    "report_numbers",
    "K8 K9 P24 P25",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '--' ELSE printf('%.2f', o_totalprice) END AS shown,
       translate(CAST(o_orderkey AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS persian, CASE WHEN o_orderkey % 7 = 0 THEN 'grey' WHEN o_totalprice < 200000 THEN 'green' ELSE 'white' END AS row_colour FROM orders""",
)
def report_numbers(spark, sf):
    value = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    rows = table(spark, sf, "orders").select("o_orderkey", value.alias("v"), sinks.persian_digits(F.col("o_orderkey").cast("string")).alias("persian"))
    rows = rows.withColumn("shown", sinks.report_number("v", 2))
    return sinks.significance_rows(rows, "v", 200000.0).select("o_orderkey", "shown", "persian", "row_colour")


@query(
    "yearly_stores",
    "S8 S9 S13 K6",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
       CAST(count(*) AS DOUBLE) AS n, CAST(max(o_totalprice) AS DOUBLE) AS top FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY 1, 2, 3""",
)
def yearly_stores(spark, sf):
    """A grid written as one chunked store for each year, and the stores from 1995 on read as one scan."""
    month, priority = F.to_date(F.trunc("o_orderdate", "month")).alias("time"), F.substring("o_orderpriority", 1, 1).cast("double").alias("priority")
    grid = cut_lineage(table(spark, sf, "orders").groupBy(month, priority).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")))
    folder = f"{ensure_checkpoint_dir(spark)}/stores-{uuid.uuid4().hex}"
    for (year,) in grid.select(F.year("time")).where("time is not null").distinct().collect():
        stores.write_zarr(grid.where(F.year("time") == year), f"{folder}/{year}.zarr", {"time": 4, "priority": 3}, ["n", "top"])
    cells = stores.read_stores(stores.list_stores(spark, folder).where("year >= 1995"), ["n", "top"])
    return cells.where("n is not null").select("year", F.month("time").alias("month"), "priority", "n", "top")


@query(
    "half_even_rounding",
    "P24",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity % 2 = 0 THEN l_quantity / 2 ELSE 2 * floor((l_quantity / 2 + 0.5) / 2) END AS DOUBLE) AS half FROM lineitem""",
)
def half_even_rounding(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2).alias("half"))


@query(
    "cache_keys",
    "P24",
    """SELECT s_nationkey, count(*) AS n, md5('v1|' || CAST(s_nationkey AS VARCHAR)) AS cache_key FROM supplier GROUP BY 1""",
)
def cache_keys(spark, sf):
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("cache_key", F.md5(F.concat(F.lit("v1|"), F.col("s_nationkey").cast("string"))))
