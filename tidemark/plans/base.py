"""The query registry and the series the registered queries share.

Stand-ins for the climate tables: orders give a level series per order priority,
line items give monthly predictors and a gridded field, orders by region and
market segment give boundary fluxes, events give irregular observations, and
suppliers give boundary rings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators import series as S
from tidemark.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register a query with the inventory ids it covers and its equivalent SQL."""

    def wrap(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(fn, sql, tuple(operators.split()))
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Fixed-point sums make the shared series identical bit for bit in every run and engine.
CENTS = 100

LEVELS_SQL = """
levels AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS t FROM (
    SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
           year(o_orderdate) AS year, month(o_orderdate) AS month,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(o_totalprice) / 1000.0 AS value,
           count(o_totalprice) AS n_obs
    FROM orders GROUP BY ALL))"""


def levels(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly level per series: ``series, date, year, month, value, n_obs, t``."""
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), "o_orderdate", "o_totalprice")
    monthly = R.monthly_mean(orders, "o_orderdate", "o_totalprice", ["series"], CENTS)
    return S.with_index(monthly.withColumn("value", F.col("value") / 1000.0), ["series"], "date")


PREDICTORS_SQL = """
predictors AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(l_quantity) AS qty,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(l_extendedprice) / 1000.0 AS price,
         CAST(sum(CAST(round(l_discount * 10000) AS BIGINT)) AS DOUBLE) / 10000.0 / count(l_discount) * 100.0 AS disc
  FROM lineitem GROUP BY ALL)"""


def predictors(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly predictors: ``date, qty, price, disc``."""
    items = table(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    return items.groupBy(S_month("l_shipdate").alias("date")).agg(
        R.exact_mean("l_quantity", CENTS).alias("qty"),
        (R.exact_mean("l_extendedprice", CENTS) / 1000.0).alias("price"),
        (R.exact_mean("l_discount", 10_000) * 100.0).alias("disc"),
    )


def S_month(ts: str):
    return F.trunc(F.col(ts).cast("date"), "MM")


JOINED_SQL = (
    LEVELS_SQL
    + ","
    + PREDICTORS_SQL
    + """,
joined AS (SELECT l.*, p.qty, p.price, p.disc FROM levels l JOIN predictors p ON l.date = p.date)"""
)


def joined(spark: SparkSession, sf: str) -> DataFrame:
    """Levels with the predictors of their month (many series to one monthly row)."""
    return levels(spark, sf).join(predictors(spark, sf), "date")


FLUX_SQL = """
flux AS (
  SELECT r_name AS sector, c_mktsegment AS side, year(o_orderdate) AS year, month(o_orderdate) AS month,
         CAST(sum(CASE WHEN o_orderstatus <> 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) / 100000000.0 AS inflow,
         CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) / 100000000.0 AS outflow
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""

# The market segments, in the order wide tables list them.
SIDES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def flux(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly flux facts: ``sector, side, year, month, inflow, outflow``."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    place = F.broadcast(  # nation and region are fixed dimensions of 25 and 5 rows
        table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    )
    customers = table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    cents = F.round(F.col("o_totalprice") * CENTS).cast("long")
    is_out = F.col("o_orderstatus") == "O"
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("r_name").alias("sector"),
            F.col("c_mktsegment").alias("side"),
            F.year("o_orderdate").cast("long").alias("year"),
            F.month("o_orderdate").cast("long").alias("month"),
        )
        .agg(
            (F.sum(F.when(~is_out, cents)).cast("double") / 1e8).alias("inflow"),
            (F.sum(F.when(is_out, cents)).cast("double") / 1e8).alias("outflow"),
        )
    )


OBS_SQL = """
obs AS (
  SELECT event_type AS series, ts, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t
  FROM events)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular observations with a position per series; a series may hold any share of the rows."""
    from tidemark.operators import blocked

    events = table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "event_id", "value")
    return blocked.row_index(events, ["series"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")))


GRID_SQL = """
grid AS (
  SELECT year(l_shipdate) AS year, 36.0 + (l_partkey % 24) * 0.5 AS lat, 46.0 + (l_suppkey % 20) * 0.5 AS lon,
         l_partkey % 24 AS iy, l_suppkey % 20 AS ix,
         CAST(sum(CAST(l_quantity AS BIGINT) - 25) AS DOUBLE) / count(*) AS u,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS DOUBLE) / count(*) AS v
  FROM lineitem GROUP BY ALL)"""

# Origin and spacing of the stand-in grid.
GRID_LAT0, GRID_LON0, GRID_STEP, GRID_NY, GRID_NX = 36.0, 46.0, 0.5, 24, 20


def grid(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Annual mean field per grid cell: ``year, lat, lon, iy, ix, u, v``; ``only`` keeps the cells it lists."""
    iy, ix = F.col("l_partkey") % GRID_NY, F.col("l_suppkey") % GRID_NX
    cells = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("year"),
        iy.alias("iy"),
        ix.alias("ix"),
        (F.col("l_quantity").cast("long") - 25).alias("u"),
        (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("v"),
    )
    if only is not None:
        cells = cells.join(only, ["iy", "ix"], "left_semi")
    means = cells.groupBy("year", "iy", "ix").agg(
        (F.sum("u").cast("double") / F.count(F.lit(1))).alias("u"), (F.sum("v").cast("double") / F.count(F.lit(1))).alias("v")
    )
    return means.withColumns({"lat": F.lit(GRID_LAT0) + F.col("iy") * GRID_STEP, "lon": F.lit(GRID_LON0) + F.col("ix") * GRID_STEP})


RINGS_SQL = """
rings AS (
  SELECT s_suppkey // 20 AS ring, s_suppkey % 20 AS seq,
         50.03 + ((s_suppkey // 20) % 5) * 0.7 + (1.37 + s_acctbal / 100000.0) * cos(2 * pi() * (s_suppkey % 20) / 20.0) AS lon,
         41.21 + ((s_suppkey // 20) % 7) * 0.3 + (1.37 + s_acctbal / 100000.0) * sin(2 * pi() * (s_suppkey % 20) / 20.0) AS lat
  FROM supplier)"""


def rings(spark: SparkSession, sf: str) -> DataFrame:
    """Closed boundary rings of up to 20 vertices: ``ring, seq, lon, lat``."""
    s = table(spark, sf, "supplier").select((F.floor(F.col("s_suppkey") / 20)).alias("ring"), (F.col("s_suppkey") % 20).alias("seq"), "s_acctbal")
    angle = 2 * F.pi() * F.col("seq") / 20.0
    radius = 1.37 + F.col("s_acctbal") / 100000.0
    return s.select(
        "ring",
        "seq",
        (50.03 + (F.col("ring") % 5) * 0.7 + radius * F.cos(angle)).alias("lon"),
        (41.21 + (F.col("ring") % 7) * 0.3 + radius * F.sin(angle)).alias("lat"),
    )


def r(c, digits: int = 6):
    """Round a computed column so that summation order does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def levels_once(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`levels`, checkpointed: for queries that read the series more than once, so the facts are read once."""
    return cut_lineage(levels(spark, sf))


def joined_once(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`joined`, checkpointed for the same reason."""
    return cut_lineage(joined(spark, sf))
