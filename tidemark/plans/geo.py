"""Boundary geometry, gridded fields and boundary flux."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import geo as G
from tidemark.operators import relational as R
from tidemark.plans.base import GRID_LAT0, GRID_LON0, GRID_NX, GRID_NY, GRID_SQL, GRID_STEP, RINGS_SQL, grid, query, r, rings, rounded, table

GRID = G.Grid(GRID_LAT0, GRID_LON0, GRID_STEP, GRID_STEP, GRID_NY, GRID_NX)
LAEA = C.EqualArea()

# ------------------------------------------------------------------ SQL forms

NEIGHBOURS_SQL = """nb AS (SELECT *, coalesce(lag(lon) OVER w, last_value(lon) OVER a) AS plon, coalesce(lag(lat) OVER w, last_value(lat) OVER a) AS plat,
  coalesce(lead(lon) OVER w, first_value(lon) OVER a) AS nlon, coalesce(lead(lat) OVER w, first_value(lat) OVER a) AS nlat
  FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq), a AS (PARTITION BY ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ar AS (SELECT ring, sum(lon * nlat - nlon * lat) / 2 AS area, sum((lon + nlon) * (lon * nlat - nlon * lat)) AS sx, sum((lat + nlat) * (lon * nlat - nlon * lat)) AS sy, count(*) AS n_vertices FROM nb GROUP BY ring)"""


def laea_forward_sql(lon: str, lat: str) -> tuple[str, str]:
    p = LAEA
    s = f"sin(radians({lat}))"
    q = f"({1 - p.e2!r} * ({s} / (1 - {p.e2!r} * {s} * {s}) - ln((1 - {p.e!r} * {s}) / (1 + {p.e!r} * {s})) / {2 * p.e!r}))"
    sb = f"({q} / {p.qp!r})"
    cb = f"sqrt(1 - {sb} * {sb})"
    dl = f"(radians({lon}) - {p.lon0!r})"
    b = f"({p.rq!r} * sqrt(2 / (1 + {p.sin_b0!r} * {sb} + {p.cos_b0!r} * {cb} * cos({dl}))))"
    return f"({b} * {p.d!r} * {cb} * sin({dl}))", f"({b} / {p.d!r} * ({p.cos_b0!r} * {sb} - {p.sin_b0!r} * {cb} * cos({dl})))"


def laea_inverse_sql(x: str, y: str) -> tuple[str, str]:
    p = LAEA
    rho = f"sqrt(pow({x} / {p.d!r}, 2) + pow({y} * {p.d!r}, 2))"
    c = f"(2 * asin({rho} / {2 * p.rq!r}))"
    beta = f"asin(cos({c}) * {p.sin_b0!r} + {p.d!r} * {y} * sin({c}) * {p.cos_b0!r} / {rho})"
    e2, e4, e6 = p.e2, p.e2**2, p.e2**3
    lat = f"degrees({beta} + {e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040!r} * sin(2 * {beta}) + {23 * e4 / 360 + 251 * e6 / 3780!r} * sin(4 * {beta}) + {761 * e6 / 45360!r} * sin(6 * {beta}))"
    lon = f"degrees({p.lon0!r} + atan2({x} * sin({c}), {p.d!r} * {rho} * {p.cos_b0!r} * cos({c}) - {p.d**2!r} * {y} * {p.sin_b0!r} * sin({c})))"
    return lon, lat


FX, FY = laea_forward_sql("lon", "lat")
IX, IY = laea_inverse_sql("mx", "my")
SEGMENT_SQL = f"""{NEIGHBOURS_SQL},
pr AS (SELECT *, {FX} AS x, {FY} AS y FROM rings),
pn AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM pr WINDOW w AS (PARTITION BY ring ORDER BY seq)),
tu AS (SELECT ring, sign(sum(x * y2 - x2 * y)) AS turn FROM pn GROUP BY ring),
se AS (SELECT pn.ring, seq, (x + x2) / 2 AS mx, (y + y2) / 2 AS my, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS length, turn * (y2 - y) AS dy, -turn * (x2 - x) AS dx FROM pn JOIN tu USING (ring)),
sg AS (SELECT ring, seq, mx, my, length, dy / length AS nx, dx / length AS ny, {IX} AS mlon, {IY} AS mlat FROM se WHERE length > 0)"""


# ------------------------------------------------------------------ rings


@query(
    "ring_orientation",
    "G8 W14 G11",
    f"WITH {RINGS_SQL}, {NEIGHBOURS_SQL} SELECT ring, round(area, 7) AS area, round(sx / (6 * area), 6) AS cx, round(sy / (6 * area), 6) AS cy, n_vertices FROM ar",
)
def ring_orientation(spark, sf):
    return rounded(rounded(G.signed_area(rings(spark, sf), ["ring"], "seq"), "area", digits=7), "cx", "cy")


@query(
    "ring_reversal",
    "G8",
    f"""WITH {RINGS_SQL}, fl AS (SELECT ring, CASE WHEN ring % 2 = 0 THEN 100 - seq ELSE seq END AS seq, lon, lat FROM rings)
SELECT ring, CASE WHEN ring % 2 = 0 AND count(*) OVER (PARTITION BY ring) > 2 THEN max(seq) OVER (PARTITION BY ring) - seq ELSE seq END AS seq, round(lon, 9) AS lon, round(lat, 9) AS lat FROM fl""",
)
def ring_reversal(spark, sf):
    """Rings of which every second one is listed clockwise, put counter-clockwise."""
    mixed = rings(spark, sf).withColumn("seq", F.when(F.col("ring") % 2 == 0, 100 - F.col("seq")).otherwise(F.col("seq")))
    out = G.counter_clockwise(mixed, ["ring"], "seq")
    return rounded(out.select("ring", "seq", "lon", "lat"), "lon", "lat", digits=9)


@query(
    "vertex_normals",
    "G9 W14",
    f"""WITH {RINGS_SQL}, {NEIGHBOURS_SQL}, d AS (SELECT nb.*, sign(area) AS turn, nlon - plon AS dx, nlat - plat AS dy FROM nb JOIN ar USING (ring))
SELECT ring, seq, round(CASE WHEN dx * dx + dy * dy > 0 THEN -dy * turn / sqrt(dx * dx + dy * dy) ELSE 0 END, 7) + 0 AS nx, round(CASE WHEN dx * dx + dy * dy > 0 THEN dx * turn / sqrt(dx * dx + dy * dy) ELSE 0 END, 7) + 0 AS ny FROM d""",
)
def vertex_normals(spark, sf):
    n = G.vertex_normals(rings(spark, sf), ["ring"], "seq")
    return n.select("ring", "seq", (r("nx", 7) + 0.0).alias("nx"), (r("ny", 7) + 0.0).alias("ny"))


@query(
    "ring_resample",
    "G7 A22 G1",
    f"""WITH {RINGS_SQL}, d AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq)),
e AS (SELECT ring, seq, lon, lat, CASE WHEN plon IS NULL THEN 0 ELSE 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) END AS step FROM d),
a AS (SELECT *, sum(step) OVER (PARTITION BY ring ORDER BY seq) AS arc FROM e),
p AS (SELECT *, lead(arc) OVER w AS arc2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM a WINDOW w AS (PARTITION BY ring ORDER BY seq)),
mx AS (SELECT ring, max(arc) AS total FROM a GROUP BY ring), tg AS (SELECT ring, unnest(range(0, CAST(floor(total / 10.0) AS BIGINT) + 1)) AS i FROM mx)
SELECT tg.ring, i, round(lon + (i * 10.0 - arc) / (arc2 - arc) * (lon2 - lon), 7) AS lon, round(lat + (i * 10.0 - arc) / (arc2 - arc) * (lat2 - lat), 7) AS lat
FROM tg JOIN p ON p.ring = tg.ring AND (i * 10.0 > arc OR (i = 0 AND arc = 0)) AND i * 10.0 <= arc2""",
)
def ring_resample(spark, sf):
    return rounded(G.resample(rings(spark, sf), ["ring"], "seq", 10.0), "lon", "lat", digits=7)


@query(
    "ring_smoothing",
    "W15",
    f"""WITH {RINGS_SQL}, k AS (SELECT o, exp(-0.5 * pow(o / 5.0, 2)) AS w FROM (SELECT unnest(range(-20, 21)) AS o)), kn AS (SELECT o, w / (SELECT sum(w) FROM k) AS w FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY ring) AS n FROM rings)
SELECT ring, (((i + o) % n) + n) % n AS seq, round(sum(w * lon), 7) AS lon, round(sum(w * lat), 7) AS lat FROM n CROSS JOIN kn GROUP BY ALL""",
)
def ring_smoothing(spark, sf):
    return rounded(G.smooth_ring(rings(spark, sf), ["ring"], "seq"), "lon", "lat", digits=7)


@query(
    "ring_segments",
    "G10 G2 W14",
    f"WITH {RINGS_SQL}, {SEGMENT_SQL} SELECT ring, seq, round(mx, 3) AS mid_x, round(my, 3) AS mid_y, round(mlon, 7) AS mid_lon, round(mlat, 7) AS mid_lat, round(length, 3) AS length, round(nx, 8) + 0 AS nx, round(ny, 8) + 0 AS ny FROM sg",
)
def ring_segments(spark, sf):
    s = G.segments(rings(spark, sf), ["ring"], "seq", LAEA)
    s = rounded(rounded(rounded(s, "mid_x", "mid_y", "length", digits=3), "mid_lon", "mid_lat", digits=7), "nx", "ny", digits=8)
    return s.withColumns({"nx": F.col("nx") + 0.0, "ny": F.col("ny") + 0.0})


@query(
    "side_by_bearing",
    "G16 P20",
    f"""WITH {RINGS_SQL}, b AS (SELECT *, degrees(atan2(lat - avg(lat) OVER (PARTITION BY ring), lon - avg(lon) OVER (PARTITION BY ring))) AS a FROM rings),
c AS (SELECT *, CASE WHEN a < 0 THEN a + 360 ELSE a END AS ang FROM b)
SELECT ring, seq, CASE WHEN ang >= 45 AND ang < 135 THEN 'North' WHEN ang >= 135 AND ang < 225 THEN 'West' WHEN ang >= 225 AND ang < 315 THEN 'South' ELSE 'East' END AS side FROM c""",
)
def side_by_bearing(spark, sf):
    return G.sides_by_bearing(rings(spark, sf), ["ring"]).select("ring", "seq", "side")


@query("side_by_arcs", "G13 G14 G15 J13")
def side_by_arcs(spark, sf):
    return G.sides_by_arcs(LAEA.project(rings(spark, sf)), ["ring"], "seq")


@query(
    "interior_point",
    "G11",
    f"WITH {RINGS_SQL}, {NEIGHBOURS_SQL} SELECT ring, round(sx / (6 * area), 6) AS lon, round(sy / (6 * area), 6) AS lat, true AS is_centroid FROM ar WHERE n_vertices > 10",
)
def interior_point(spark, sf):
    full = rings(spark, sf)
    whole = full.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).where("n > 10").select("ring")
    return rounded(G.interior_point(full.join(whole, "ring", "left_semi"), ["ring"], "seq"), "lon", "lat")


@query(
    "interior_point_all",
    "G11",
    f"""WITH {RINGS_SQL}, {NEIGHBOURS_SQL}, ce AS (SELECT ring, CASE WHEN area <> 0 THEN sx / (6 * area) END AS cx, CASE WHEN area <> 0 THEN sy / (6 * area) END AS cy FROM ar),
ins AS (SELECT nb.ring, coalesce(sum(CASE WHEN (lat > cy) <> (nlat > cy) AND lon + (cy - lat) * (nlon - lon) / (nlat - lat) > cx THEN 1 ELSE 0 END), 0) % 2 = 1 AS inside FROM nb JOIN ce USING (ring) GROUP BY nb.ring),
mid AS (SELECT ring, (min(lat) + max(lat)) / 2 AS m FROM nb GROUP BY ring),
cr AS (SELECT nb.ring, m, lon + (m - lat) * (nlon - lon) / (nlat - lat) AS x FROM nb JOIN mid USING (ring) WHERE (lat > m) <> (nlat > m)),
ch AS (SELECT *, row_number() OVER w AS k, lead(x) OVER w AS upto FROM cr WINDOW w AS (PARTITION BY ring ORDER BY x)),
wi AS (SELECT ring, arg_max((x + upto) / 2, upto - x) AS x, any_value(m) AS y FROM ch WHERE k % 2 = 1 GROUP BY ring)
SELECT ce.ring, round(CASE WHEN cx IS NULL THEN NULL WHEN inside THEN cx ELSE wi.x END, 6) AS lon, round(CASE WHEN cx IS NULL THEN NULL WHEN inside THEN cy ELSE wi.y END, 6) AS lat, inside AS is_centroid
FROM ce JOIN ins USING (ring) LEFT JOIN wi USING (ring)""",
)
def interior_point_all(spark, sf):
    return rounded(G.interior_point(rings(spark, sf), ["ring"], "seq"), "lon", "lat")


@query(
    "spline_densify",
    "G12",
    f"""WITH RECURSIVE {RINGS_SQL}, o AS (SELECT ring, lon AS x, lat AS y, row_number() OVER (PARTITION BY ring ORDER BY seq) AS i, count(*) OVER (PARTITION BY ring) AS n FROM rings),
e AS (SELECT a.ring, a.i, a.n, a.x, a.y, b.x AS nx, b.y AS ny, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS h FROM o a JOIN o b ON a.ring = b.ring AND b.i = a.i % a.n + 1 WHERE a.n >= 3),
l AS (SELECT ring, any_value(n) AS n, list(h ORDER BY i) AS h, list((nx - x) / h ORDER BY i) AS sx, list((ny - y) / h ORDER BY i) AS sy, list(x ORDER BY i) AS x, list(y ORDER BY i) AS y, sum(h) AS total FROM e GROUP BY ring),
it AS (SELECT ring, 0 AS k, list_transform(h, lambda v: 0.0::DOUBLE) AS mx, list_transform(h, lambda v: 0.0::DOUBLE) AS my, n, h, sx, sy FROM l
  UNION ALL SELECT ring, k + 1, list_transform(range(1, n + 1), lambda j: (6 * (sx[j] - sx[(j + n - 2) % n + 1]) - h[(j + n - 2) % n + 1] * mx[(j + n - 2) % n + 1] - h[j] * mx[j % n + 1]) / (2 * (h[(j + n - 2) % n + 1] + h[j]))),
    list_transform(range(1, n + 1), lambda j: (6 * (sy[j] - sy[(j + n - 2) % n + 1]) - h[(j + n - 2) % n + 1] * my[(j + n - 2) % n + 1] - h[j] * my[j % n + 1]) / (2 * (h[(j + n - 2) % n + 1] + h[j]))), n, h, sx, sy FROM it WHERE k < 70),
u AS (SELECT ring, i, n, h, coalesce(sum(h) OVER (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM e),
q AS (SELECT l.ring, p, p * l.total / 299 AS pos FROM l, (SELECT unnest(range(0, 300)) AS p)),
f AS (SELECT q.ring, p, u.i, u.i % u.n + 1 AS j, u.u + u.h - pos AS a, pos - u.u AS b, u.h FROM q JOIN u ON q.ring = u.ring AND pos >= u.u AND (pos < u.u + u.h OR u.i = u.n))
SELECT f.ring, p AS seq, round((mx[i] * pow(a, 3) + mx[j] * pow(b, 3)) / (6 * f.h) + (x[i] / f.h - mx[i] * f.h / 6) * a + (x[j] / f.h - mx[j] * f.h / 6) * b, 5) AS lon,
       round((my[i] * pow(a, 3) + my[j] * pow(b, 3)) / (6 * f.h) + (y[i] / f.h - my[i] * f.h / 6) * a + (y[j] / f.h - my[j] * f.h / 6) * b, 5) AS lat
FROM f JOIN l ON l.ring = f.ring JOIN it ON it.ring = f.ring AND it.k = 70
UNION ALL SELECT ring, i - 1, round(x, 5), round(y, 5) FROM o WHERE n < 3""",
)
def spline_densify(spark, sf):
    return rounded(G.densify(rings(spark, sf), ["ring"], "seq", 300), "lon", "lat", digits=5)


@query(
    "nearest_vertex",
    "J13 P12",
    f"""WITH {RINGS_SQL}, v AS (SELECT ring * 100 + seq AS vertex, lon, lat FROM rings), p AS (SELECT DISTINCT l_partkey % 24 * 100 + l_suppkey % 20 AS point, 46.0 + (l_suppkey % 20) * 0.5 AS lon, 36.0 + (l_partkey % 24) * 0.5 AS lat FROM lineitem),
d AS (SELECT point, vertex, sqrt(pow(p.lon - v.lon, 2) + pow(p.lat - v.lat, 2)) AS d FROM p, v)
SELECT point, arg_min(vertex, d) AS vertex, round(min(d), 7) AS distance FROM d GROUP BY point""",
)
def nearest_vertex(spark, sf):
    vertices = rings(spark, sf).select((F.col("ring") * 100 + F.col("seq")).alias("vertex"), "lon", "lat")
    iy, ix = F.col("l_partkey") % 24, F.col("l_suppkey") % 20
    points = table(spark, sf, "lineitem").select((iy * 100 + ix).alias("point"), (46.0 + ix * 0.5).alias("lon"), (36.0 + iy * 0.5).alias("lat")).distinct()
    return rounded(G.nearest_vertex(points, vertices, "point", "vertex"), "distance", digits=7)


# ------------------------------------------------------------------ grids


@query(
    "pixel_area",
    "G3 G4",
    f"""WITH {GRID_SQL}, l AS (SELECT DISTINCT iy, lat FROM grid), e AS (SELECT iy, lat, sqrt((pow(cos(radians(lat)) * pow(6378137.0, 2), 2) + pow(sin(radians(lat)) * pow(6356752.3, 2), 2)) / (pow(cos(radians(lat)) * 6378137.0, 2) + pow(sin(radians(lat)) * 6356752.3, 2))) AS radius FROM l)
SELECT iy, round(radius, 3) AS radius_m, round(0.25 * pow(pi() / 180, 2) * radius * radius * cos(radians(lat)) / 1000000.0, 4) AS area_km2 FROM e""",
)
def pixel_area(spark, sf):
    rows = grid(spark, sf).select("iy", "lat").distinct()
    return rows.select("iy", r(C.earth_radius_m("lat"), 3).alias("radius_m"), r(C.pixel_area_m2("lat", 0.5, 0.5) / 1e6, 4).alias("area_km2"))


MASK_SQL = f"""{NEIGHBOURS_SQL},
cells AS (SELECT iy, ix, 36.0 + iy * 0.5 AS clat, 46.0 + ix * 0.5 AS clon FROM (SELECT unnest(range(0, 24)) AS iy), (SELECT unnest(range(0, 20)) AS ix)),
mask AS (SELECT ring, iy, ix FROM cells JOIN nb ON (lat > clat) <> (nlat > clat) WHERE lon + (clat - lat) * (nlon - lon) / (nlat - lat) > clon GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("point_in_polygon", "J12 G5", f"WITH {RINGS_SQL}, {MASK_SQL} SELECT ring, iy, ix FROM mask")
def point_in_polygon(spark, sf):
    return G.polygon_mask(rings(spark, sf), ["ring"], "seq", GRID)


@query(
    "weighted_area_mean",
    "A14 A15 G21",
    f"""WITH {RINGS_SQL}, {GRID_SQL}, {MASK_SQL} SELECT ring, year, round(sum(cos(radians(lat)) * u) / sum(cos(radians(lat))), 7) AS mean, count(u) AS n_cells FROM grid JOIN mask USING (iy, ix) GROUP BY ALL""",
)
def weighted_area_mean(spark, sf):
    mask = G.polygon_mask(rings(spark, sf), ["ring"], "seq", GRID)
    return rounded(G.masked_mean(grid(spark, sf), mask, ["ring"], ["year"], "u", F.cos(F.radians("lat"))), "mean", digits=7)


@query(
    "pixel_weighted_mean",
    "A14 G4 G21",
    f"""WITH {RINGS_SQL}, {GRID_SQL}, {MASK_SQL}, g AS (SELECT *, cos(radians(lat)) * (pow(cos(radians(lat)) * pow(6378137.0, 2), 2) + pow(sin(radians(lat)) * pow(6356752.3, 2), 2)) / (pow(cos(radians(lat)) * 6378137.0, 2) + pow(sin(radians(lat)) * 6356752.3, 2)) AS w FROM grid)
SELECT ring, year, round(sum(w * v) / sum(w), 7) AS mean, count(v) AS n_cells FROM g JOIN mask USING (iy, ix) GROUP BY ALL""",
)
def pixel_weighted_mean(spark, sf):
    mask = G.polygon_mask(rings(spark, sf), ["ring"], "seq", GRID)
    return rounded(G.masked_mean(grid(spark, sf), mask, ["ring"], ["year"], "v", C.pixel_area_m2("lat", 0.5, 0.5)), "mean", digits=7)


@query("grid_time_mean", "A21 D6", "SELECT l_partkey % 24 AS iy, l_suppkey % 20 AS ix, CAST(sum(CAST(l_quantity AS BIGINT) - 25) AS DOUBLE) / count(*) AS u FROM lineitem GROUP BY ALL")
def grid_time_mean(spark, sf):
    cells = table(spark, sf, "lineitem").select((F.col("l_partkey") % 24).alias("iy"), (F.col("l_suppkey") % 20).alias("ix"), (F.col("l_quantity").cast("long") - 25).alias("u"))
    return cells.groupBy("iy", "ix").agg((F.sum("u").cast("double") / F.count(F.lit(1))).alias("u"))


SAMPLE_SQL = f"""{SEGMENT_SQL},
fp AS (SELECT *, (mlon - 46.0) / 0.5 AS fx, (mlat - 36.0) / 0.5 AS fy FROM sg),
f0 AS (SELECT *, CAST(least(floor(fx), 18) AS BIGINT) AS x0, CAST(least(floor(fy), 22) AS BIGINT) AS y0 FROM fp WHERE fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 23),
co AS (SELECT f0.*, year, x0 + dx AS ix, y0 + dy AS iy, (CASE dx WHEN 1 THEN fx - x0 ELSE 1 - (fx - x0) END) * (CASE dy WHEN 1 THEN fy - y0 ELSE 1 - (fy - y0) END) AS w, u, v
  FROM f0 CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) q(dx, dy) JOIN grid g ON g.ix = x0 + dx AND g.iy = y0 + dy),
sa AS (SELECT ring, seq, year, any_value(nx) AS nx, any_value(ny) AS ny, any_value(length) AS length, any_value(mlon) AS mlon, any_value(mlat) AS mlat, CASE WHEN count(*) = 4 THEN sum(w * u) END AS u, CASE WHEN count(*) = 4 THEN sum(w * v) END AS v FROM co GROUP BY ring, seq, year)"""


def samples(spark, sf):
    """Annual field sampled at segment midpoints; the field is pruned to the cells in use before it is averaged."""
    corners = G.bilinear_corners(G.segments(rings(spark, sf), ["ring"], "seq", LAEA), GRID)
    field = grid(spark, sf, G.touched_cells(corners))
    return G.bilinear_sample(corners, field, ["ring", "seq"], ["year"], ["u", "v"])


@query("bilinear_sample", "J15 G6", f"WITH {RINGS_SQL}, {GRID_SQL}, {SAMPLE_SQL} SELECT ring, seq, year, round(u, 6) AS u, round(v, 6) AS v FROM sa")
def bilinear_sample(spark, sf):
    return rounded(samples(spark, sf).select("ring", "seq", "year", "u", "v"), "u", "v")


FLUX_BY_SIDE_SQL = f"""{SAMPLE_SQL}, ce AS (SELECT ring, avg(mid.mlon) AS lon0, avg(mid.mlat) AS lat0 FROM sg mid GROUP BY ring),
sd AS (SELECT sa.*, degrees(atan2(mlat - lat0, mlon - lon0)) AS a0 FROM sa JOIN ce USING (ring)),
sb AS (SELECT *, CASE WHEN a0 < 0 THEN a0 + 360 ELSE a0 END AS ang FROM sd),
sf AS (SELECT ring, year, CASE WHEN ang >= 45 AND ang < 135 THEN 'North' WHEN ang >= 135 AND ang < 225 THEN 'West' WHEN ang >= 225 AND ang < 315 THEN 'South' ELSE 'East' END AS side, (u * nx + v * ny) AS q, length FROM sb),
fl AS (SELECT ring, year, side, sum(greatest(-q, q * 0) * length) AS inflow, sum(greatest(q, q * 0) * length) AS outflow, count(q) AS n_segments FROM sf GROUP BY ALL)"""


def flux_by_side(spark, sf):
    segs = G.segments(rings(spark, sf), ["ring"], "seq", LAEA)
    named = G.sides_by_bearing(segs, ["ring"], "mid_lon", "mid_lat")
    corners = G.bilinear_corners(named, GRID)
    field = grid(spark, sf, G.touched_cells(corners))
    sampled = G.bilinear_sample(corners, field, ["ring", "seq"], ["year"], ["u", "v"])
    return G.boundary_flux(G.repair_outliers(sampled, ["ring", "year"]), ["ring", "year", "side"])


@query("segment_flux", "G17 J14 J15 P19 D10 D11", f"WITH {RINGS_SQL}, {GRID_SQL}, {FLUX_BY_SIDE_SQL} SELECT ring, year, side, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow, n_segments FROM fl")
def segment_flux(spark, sf):
    return rounded(flux_by_side(spark, sf), "inflow", "outflow", digits=2)


@query(
    "flux_repaired",
    "J14 P19",
    f"""WITH {RINGS_SQL}, {GRID_SQL}, {SAMPLE_SQL}, bad AS (SELECT *, abs(u) > 9 OR abs(v) > 9 AS wrong FROM sa WHERE u IS NOT NULL),
mm AS (SELECT b.ring, b.year, b.seq, s.mx, s.my, b.u, b.v, b.wrong FROM bad b JOIN sg s USING (ring, seq)),
gd AS (SELECT * FROM mm WHERE NOT wrong), ng AS (SELECT ring, year, count(*) AS n, avg(u) AS au, avg(v) AS av FROM gd GROUP BY ALL),
ne AS (SELECT m.ring, m.year, m.seq, arg_min(g.u, pow(g.mx - m.mx, 2) + pow(g.my - m.my, 2)) AS u, arg_min(g.v, pow(g.mx - m.mx, 2) + pow(g.my - m.my, 2)) AS v FROM mm m JOIN gd g ON g.ring = m.ring AND g.year = m.year WHERE m.wrong GROUP BY ALL)
SELECT m.ring, m.year, m.seq, round(CASE WHEN NOT m.wrong THEN m.u WHEN n > 2 THEN ne.u ELSE au END, 6) AS u, round(CASE WHEN NOT m.wrong THEN m.v WHEN n > 2 THEN ne.v ELSE av END, 6) AS v
FROM mm m LEFT JOIN ne ON ne.ring = m.ring AND ne.year = m.year AND ne.seq = m.seq LEFT JOIN ng ON ng.ring = m.ring AND ng.year = m.year""",
)
def flux_repaired(spark, sf):
    clean = samples(spark, sf).where(F.col("u").isNotNull())
    return rounded(G.repair_outliers(clean, ["ring", "year"], limit=9.0).select("ring", "year", "seq", "u", "v"), "u", "v")


@query(
    "conservation",
    "G19 A17",
    f"""WITH {RINGS_SQL}, {GRID_SQL}, {FLUX_BY_SIDE_SQL}, g AS (SELECT ring, year, sum(inflow) AS i, sum(outflow) AS o FROM fl GROUP BY ALL)
SELECT ring, year, round(i, 2) AS total_inflow, round(o, 2) AS total_outflow, round(i - o, 2) AS net, round(abs(i - o) / (i + o + 1e-10) * 100, 6) AS error_pct FROM g""",
)
def conservation(spark, sf):
    return rounded(rounded(G.conservation(flux_by_side(spark, sf), ["ring", "year"]), "total_inflow", "total_outflow", "net", digits=2), "error_pct")


@query(
    "flux_wide_sides",
    "A9 D12 G17",
    f"WITH {RINGS_SQL}, {GRID_SQL}, {FLUX_BY_SIDE_SQL} SELECT ring, year, "
    + ", ".join(f"round(max(CASE WHEN side = '{s}' THEN {f} END), 2) AS {s}_{f}" for f in ("inflow", "outflow") for s in ("East", "North", "South", "West"))
    + " FROM fl GROUP BY ring, year",
)
def flux_wide_sides(spark, sf):
    sides = ("East", "North", "South", "West")
    wide = R.flux_wide(flux_by_side(spark, sf), ["ring", "year"], "side", sides)
    return rounded(wide, *[f"{s}_{f}" for f in ("inflow", "outflow") for s in sides], digits=2)


@query(
    "vertical_integral",
    "G20",
    """WITH l AS (SELECT l_orderkey, l_linenumber * 10000.0::DOUBLE AS p, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey, (q + lag(q) OVER w) / 2 * (p - lag(p) OVER w) AS piece FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY p))
SELECT l_orderkey, round(coalesce(sum(piece), 0) / 9.80665, 5) AS integral FROM d GROUP BY l_orderkey""",
)
def vertical_integral(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 10000.0).alias("p")).agg(F.sum("l_quantity").alias("q"))
    return rounded(G.vertical_integral(items, ["l_orderkey"], "p", "q"), "integral", digits=5)


@query(
    "largest_part",
    "S12 D8",
    f"""WITH {RINGS_SQL}, {NEIGHBOURS_SQL}, b AS (SELECT ring % 3 AS shape, arg_max(ring, abs(area)) AS ring FROM ar GROUP BY 1)
SELECT b.shape, r.ring, seq FROM rings r JOIN b ON b.ring = r.ring""",
)
def largest_part(spark, sf):
    parts = rings(spark, sf).withColumn("shape", F.col("ring") % 3)
    return G.largest_part(parts, ["shape"], "ring", "seq").select("shape", "ring", "seq")
