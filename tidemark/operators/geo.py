"""Boundary geometry over rings and gridded fields, and the flux through a boundary.

Rings are vertex rows ``(keys, seq, lon, lat)``; grids are cell rows indexed by
``iy, ix``.  Geometry meets the grid through equality joins on cell indices, so
a field of any size is read once and pruned to the cells a boundary touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.functions import columns as C
from tidemark.functions import kernels
from tidemark.operators import nearest as N
from tidemark.operators import series as S
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Grid:
    """A regular grid: the centre of cell ``(iy, ix)`` is ``(lat0 + iy dlat, lon0 + ix dlon)``."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    ny: int
    nx: int


# ------------------------------------------------------------------ rings


def arc_length(points: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Cumulative great-circle length along each polyline."""
    w = S.by(keys, seq)
    step = F.coalesce(C.haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("arc_km", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def resample(points: DataFrame, keys: Sequence[str], seq: str, spacing_km: float) -> DataFrame:
    """Points every ``spacing_km`` along each polyline: ``keys, i, lon, lat``.

    Each piece emits the targets that fall on it, so no search is needed.
    """
    w = S.by(keys, seq)
    a = arc_length(points, keys, seq)
    pieces = a.select(
        *keys, "lon", "lat", F.col("arc_km").alias("_a"), F.lead("arc_km").over(w).alias("_b"), F.lead("lon").over(w).alias("_lon2"), F.lead("lat").over(w).alias("_lat2")
    ).where(F.col("_b") > F.col("_a"))
    first = F.when(F.col("_a") == 0, 0).otherwise(F.floor(F.col("_a") / spacing_km) + 1).cast("long")
    last = F.floor(F.col("_b") / spacing_km).cast("long")
    hit = pieces.withColumns({"_i0": first, "_i1": last}).where("_i0 <= _i1").withColumn("i", F.explode(F.sequence("_i0", "_i1")))
    share = (F.col("i") * spacing_km - F.col("_a")) / (F.col("_b") - F.col("_a"))
    return hit.select(*keys, "i", (F.col("lon") + share * (F.col("_lon2") - F.col("lon"))).alias("lon"), (F.col("lat") + share * (F.col("_lat2") - F.col("lat"))).alias("lat"))


def smooth_ring(ring: DataFrame, keys: Sequence[str], seq: str, sigma: float = 5.0, truncate: float = 4.0) -> DataFrame:
    """Circular Gaussian smoothing of ring coordinates: each vertex spreads over a kernel of fixed width."""
    radius = int(truncate * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    weights /= weights.sum()
    kernel = F.array(*[F.struct(F.lit(int(o)).alias("o"), F.lit(float(w)).alias("w")) for o, w in zip(offsets, weights)])
    n = ring.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spread = S.with_index(ring, keys, seq, "_i").join(n, list(keys)).select("*", F.inline(kernel))
    spread = spread.withColumn("_to", F.pmod(F.col("_i") + F.col("o"), F.col("_n")))
    out = spread.groupBy(*keys, "_to").agg(F.sum(F.col("w") * F.col("lon")).alias("lon"), F.sum(F.col("w") * F.col("lat")).alias("lat"))
    return out.withColumnRenamed("_to", seq)


def signed_area(ring: DataFrame, keys: Sequence[str], seq: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Shoelace area, centroid and vertex count per ring; a positive area runs counter-clockwise."""
    r = S.ring_neighbours(ring, keys, seq, [x, y])
    cross = F.col(x) * F.col(f"next_{y}") - F.col(f"next_{x}") * F.col(y)
    g = r.groupBy(*keys).agg(
        (F.sum(cross) / 2).alias("area"),
        F.sum((F.col(x) + F.col(f"next_{x}")) * cross).alias("_cx"),
        F.sum((F.col(y) + F.col(f"next_{y}")) * cross).alias("_cy"),
        F.count(F.lit(1)).alias("n_vertices"),
    )
    return g.select(*keys, "area", F.try_divide(F.col("_cx"), 6 * F.col("area")).alias("cx"), F.try_divide(F.col("_cy"), 6 * F.col("area")).alias("cy"), "n_vertices")


def largest_part(parts: DataFrame, keys: Sequence[str], part: str, seq: str) -> DataFrame:
    """Of each shape's rings keep the one with the largest area (the lowest part number on ties)."""
    area = signed_area(parts, [*keys, part], seq)
    best = area.groupBy(*keys).agg(F.min(F.struct((-F.abs(F.col("area"))).alias("a"), F.col(part).alias("p"))).alias("_b"))
    return parts.join(best.select(*keys, F.col("_b.p").alias(part)), [*keys, part], "left_semi")


def _turn(keys: Sequence[str], x: str, y: str) -> Column:
    """Orientation of the ring a neighbour row belongs to: +1 counter-clockwise, -1 clockwise.

    A window on the partitioning the neighbours already have, so it costs no shuffle.
    """
    cross = F.col(x) * F.col(f"next_{y}") - F.col(f"next_{x}") * F.col(y)
    return F.signum(F.sum(cross).over(Window.partitionBy(*keys)))


def counter_clockwise(ring: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Reverse the vertex order of clockwise rings."""
    out = S.ring_neighbours(ring, keys, seq, ["lon", "lat"])
    last = F.max(seq).over(Window.partitionBy(*keys))
    out = out.withColumns({"_turn": _turn(keys, "lon", "lat"), "_last": last})
    return out.withColumn(seq, F.when(F.col("_turn") < 0, F.col("_last") - F.col(seq)).otherwise(F.col(seq))).select(ring.columns)


def vertex_normals(ring: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Unit inward normals by central difference, for either orientation of the ring."""
    r = S.ring_neighbours(ring, keys, seq, ["lon", "lat"]).withColumn("_turn", _turn(keys, "lon", "lat"))
    dx, dy = F.col("next_lon") - F.col("prev_lon"), F.col("next_lat") - F.col("prev_lat")
    size = F.sqrt(dx * dx + dy * dy)
    unit = lambda v: F.when(size > 0, v * F.col("_turn") / size).otherwise(0.0)
    return r.select(*keys, seq, "lon", "lat", unit(-dy).alias("nx"), unit(dx).alias("ny"))


def segments(ring: DataFrame, keys: Sequence[str], seq: str, projection: C.EqualArea | None = None) -> DataFrame:
    """Edges of each ring in projected metres: midpoint (also lon/lat), length, outward unit normal.

    Without a projection the ring's ``x, y`` columns are taken as planar coordinates.
    """
    p = projection.project(ring) if projection else ring
    e = S.ring_neighbours(p, keys, seq, ["x", "y"]).withColumn("_turn", _turn(keys, "x", "y"))
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    e = e.withColumns({"_dx": dx, "_dy": dy, "length": F.sqrt(dx * dx + dy * dy)}).where(F.col("length") > 0)
    e = e.withColumns(
        {
            "mid_x": (F.col("x") + F.col("next_x")) / 2,
            "mid_y": (F.col("y") + F.col("next_y")) / 2,
            "nx": F.col("_turn") * F.col("_dy") / F.col("length"),
            "ny": -F.col("_turn") * F.col("_dx") / F.col("length"),
        }
    )
    if projection:
        e = projection.unproject(e, "mid_x", "mid_y", "mid_lon", "mid_lat")
    return e.select(*keys, seq, "mid_x", "mid_y", *(["mid_lon", "mid_lat"] if projection else []), "length", "nx", "ny")


def edges(ring: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    r = S.ring_neighbours(ring, keys, seq, ["lon", "lat"])
    return r.select(*keys, F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("next_lon").alias("x2"), F.col("next_lat").alias("y2"))


def interior_point(ring: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """A point inside each ring: the centroid if it lies inside, else the middle of the widest chord at mid height; null without area."""
    c = signed_area(ring, keys, seq).select(*keys, "cx", "cy")
    box = ring.groupBy(*keys).agg(((F.min("lat") + F.max("lat")) / 2).alias("_mid"))
    e = edges(ring, keys, seq).join(c, list(keys)).join(box, list(keys))
    x_at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crosses = lambda y: (F.col("y1") > y) != (F.col("y2") > y)
    right = F.sum(F.when(crosses(F.col("cy")) & (x_at(F.col("cy")) > F.col("cx")), 1).otherwise(0))
    inside = e.groupBy(*keys).agg((right % 2 == 1).alias("_inside"))
    cut = e.where(crosses(F.col("_mid"))).select(*keys, "_mid", x_at(F.col("_mid")).alias("_x"))
    w = Window.partitionBy(*keys).orderBy("_x")
    chord = cut.withColumns({"_k": F.row_number().over(w), "_to": F.lead("_x").over(w)}).where("_k % 2 = 1")
    widest = chord.groupBy(*keys).agg(F.max_by(F.struct(((F.col("_x") + F.col("_to")) / 2).alias("x"), F.col("_mid").alias("y")), F.col("_to") - F.col("_x")).alias("_w"))
    out = c.join(inside, list(keys)).join(widest, list(keys), "left")
    pick = lambda own, alt: F.when(F.col("cx").isNotNull(), F.when(F.col("_inside"), F.col(own)).otherwise(F.col(alt)))
    return out.select(*keys, pick("cx", "_w.x").alias("lon"), pick("cy", "_w.y").alias("lat"), "_inside").withColumnRenamed("_inside", "is_centroid")


def sides_by_bearing(ring: DataFrame, keys: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Label each vertex by its compass quadrant around the mean vertex of its ring."""
    w = Window.partitionBy(*keys)
    centred = ring.withColumns({"_lon0": F.avg(lon).over(w), "_lat0": F.avg(lat).over(w)})
    return centred.withColumn("side", C.bearing_side(lon, lat, "_lon0", "_lat0")).drop("_lon0", "_lat0")


def sides_by_arcs(ring: DataFrame, keys: Sequence[str], seq: str, x: str = "x", y: str = "y") -> DataFrame:
    """Cut each ring into four contiguous arcs and name them by bearing: ``keys, seq, arc, method, side``."""
    rows = ring.select(*keys, seq, F.col(x).alias("_x"), F.col(y).alias("_y"))
    schema = StructType([*rows.schema.fields, StructField("arc", LongType()), StructField("method", StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        arc, how = kernels.ring_arcs(pdf[["_x", "_y"]].to_numpy(float))
        return pdf.assign(arc=arc, method=how)

    cut = rows.groupBy(*keys).applyInPandas(run, schema)
    centre = cut.groupBy(*keys).agg(F.avg("_x").alias("_cx"), F.avg("_y").alias("_cy"))
    named = cut.groupBy(*keys, "arc").agg(F.avg("_x").alias("_ax"), F.avg("_y").alias("_ay")).join(centre, list(keys))
    named = named.select(*keys, "arc", C.bearing_side("_ax", "_ay", "_cx", "_cy").alias("side"))
    return cut.drop("_x", "_y").join(named, [*keys, "arc"])


def densify(ring: DataFrame, keys: Sequence[str], seq: str, points: int = 300, x: str = "lon", y: str = "lat") -> DataFrame:
    """Each ring redrawn as a closed cubic spline with ``points`` samples."""
    rows = ring.select(*keys, seq, x, y)
    schema = StructType([*[f for f in rows.schema.fields if f.name in keys], StructField(seq, LongType()), StructField(x, DoubleType()), StructField(y, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = kernels.periodic_spline(pdf.sort_values(seq)[[x, y]].to_numpy(float), points)
        out = pd.DataFrame({seq: np.arange(len(xy)), x: xy[:, 0], y: xy[:, 1]})
        for k in reversed(list(keys)):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*keys).applyInPandas(run, schema)


def nearest_vertex(points: DataFrame, vertices: DataFrame, point_id: str, vertex_id: str, few: int = N.FEW) -> DataFrame:
    """Nearest vertex of each point in coordinate distance, of equal ones the least: ``point_id, vertex_id, distance``.

    A point without coordinates has neither vertex nor distance; a vertex without coordinates is never found.
    """
    if vertices.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")).isEmpty():
        raise ValueError("no vertices to search")
    v = vertices.select(F.col(vertex_id).alias("_vertex"), F.col("lon").alias("_vx"), F.col("lat").alias("_vy"))
    found = N.nearest(points, v, [], [point_id], "lon", "lat", ["_vertex"], "_vx", "_vy", few)
    found = found.select(F.col(point_id).alias("_p"), F.col("_vertex").alias(vertex_id), F.sqrt("d2").alias("distance"))
    return points.select(point_id).join(found, F.col(point_id).eqNullSafe(F.col("_p")), "left").drop("_p")


# ------------------------------------------------------------------ grids


def polygon_mask(ring: DataFrame, keys: Sequence[str], seq: str, grid: Grid) -> DataFrame:
    """Grid cells whose centre lies inside each ring: ``keys, iy, ix``.

    Each edge emits its crossing of the cell rows it spans; sorted crossings of a
    row pair up into spans, and a span lists its cells.  The work follows the
    outline and the result, never cells times edges.  Either step of the grid may
    be negative.
    """
    e = edges(ring, keys, seq).where(F.col("y1") != F.col("y2"))
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    at_lo, at_hi = (lo - grid.lat0) / grid.dlat, (hi - grid.lat0) / grid.dlat
    ends = (F.ceil(at_lo), F.ceil(at_hi) - 1) if grid.dlat > 0 else (F.floor(at_hi) + 1, F.floor(at_lo))  # lo <= row < hi
    first, last = F.greatest(ends[0], F.lit(0)).cast("long"), F.least(ends[1], F.lit(grid.ny - 1)).cast("long")
    rows = e.withColumns({"_r0": first, "_r1": last}).where("_r0 <= _r1").withColumn("iy", F.explode(F.sequence("_r0", "_r1")))
    y = grid.lat0 + F.col("iy") * grid.dlat
    rows = rows.select(*keys, "iy", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("_x"))
    w = Window.partitionBy(*keys, "iy").orderBy("_x")
    spans = rows.withColumns({"_k": F.row_number().over(w), "_to": F.lead("_x").over(w)}).where("_k % 2 = 1 AND _to IS NOT NULL")
    west, east = ("_x", "_to") if grid.dlon > 0 else ("_to", "_x")
    a = F.greatest(F.floor((F.col(west) - grid.lon0) / grid.dlon) + 1, F.lit(0)).cast("long")
    b = F.least(F.ceil((F.col(east) - grid.lon0) / grid.dlon) - 1, F.lit(grid.nx - 1)).cast("long")
    spans = spans.withColumns({"_a": a, "_b": b}).where("_a <= _b")
    return spans.select(*keys, "iy", F.explode(F.sequence("_a", "_b")).alias("ix"))


def masked_mean(field: DataFrame, mask: DataFrame, keys: Sequence[str], time: Sequence[str], value: str, weight: Column) -> DataFrame:
    """Weighted mean of a field over each masked area and time; missing cells carry no weight."""
    cells = field.join(mask, ["iy", "ix"]).withColumn("_w", F.when(F.col(value).isNotNull(), weight))
    return cells.groupBy(*keys, *time).agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("mean"), F.count(value).alias("n_cells"))


def bilinear_corners(points: DataFrame, grid: Grid, lon: str = "mid_lon", lat: str = "mid_lat") -> DataFrame:
    """The four surrounding cells of each point with their weights, one row per cell; points off the grid drop out."""
    fx, fy = (F.col(lon) - grid.lon0) / grid.dlon, (F.col(lat) - grid.lat0) / grid.dlat
    p = points.withColumns({"_fx": fx, "_fy": fy}).where((F.col("_fx") >= 0) & (F.col("_fx") <= grid.nx - 1) & (F.col("_fy") >= 0) & (F.col("_fy") <= grid.ny - 1))
    x0, y0 = F.least(F.floor("_fx"), F.lit(grid.nx - 2)).cast("long"), F.least(F.floor("_fy"), F.lit(grid.ny - 2)).cast("long")
    p = p.withColumns({"_x0": x0, "_y0": y0})
    wx, wy = F.col("_fx") - F.col("_x0"), F.col("_fy") - F.col("_y0")
    corner = lambda dx, dy, w: F.struct((F.col("_y0") + dy).alias("iy"), (F.col("_x0") + dx).alias("ix"), w.alias("w"))
    cells = F.array(corner(0, 0, (1 - wx) * (1 - wy)), corner(1, 0, wx * (1 - wy)), corner(0, 1, (1 - wx) * wy), corner(1, 1, wx * wy))
    return p.select(*points.columns, F.inline(cells))


def touched_cells(corners: DataFrame) -> DataFrame:
    """Distinct cells a set of points reads: what a field needs to keep before it is averaged over time."""
    return corners.select("iy", "ix").distinct()


def bilinear_sample(corners: DataFrame, field: DataFrame, ids: Sequence[str], time: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Field values at points; NULL where one of the four cells is missing."""
    joined = corners.join(field.select("iy", "ix", *time, *values), ["iy", "ix"])
    whole = F.count(F.lit(1)) == 4
    agg = [F.when(whole & (F.count(v) == 4), F.sum(F.col("w") * F.col(v))).alias(v) for v in values]
    keep = [c for c in corners.columns if c not in (*ids, "iy", "ix", "w")]
    return joined.groupBy(*ids, *time).agg(*agg, *[F.first(c).alias(c) for c in keep])


def repair_outliers(samples: DataFrame, groups: Sequence[str], limit: float = 3000.0) -> DataFrame:
    """Replace samples beyond ``limit`` by the nearest valid one of their group (mean of the valid when at most two).

    Only the places of outliers search, among the valid samples of their group; no group is gathered. Of equally near
    samples the one with the least values is taken; without a valid one the sample is null.
    """
    bad = F.coalesce((F.abs(F.col("u")) > limit) | (F.abs(F.col("v")) > limit), F.lit(False))
    rows = cut_lineage(samples.withColumn("_bad", bad))
    if rows.where("_bad").isEmpty():
        return rows.drop("_bad")
    wrong = cut_lineage(rows.where("_bad").select(*groups, "mid_x", "mid_y").distinct())
    good = rows.where(~F.col("_bad") & F.col("u").isNotNull() & F.col("v").isNotNull()).join(wrong.select(*groups).distinct(), list(groups), "left_semi")
    good = cut_lineage(good.select(*groups, "mid_x", "mid_y", "u", "v"))
    means = good.groupBy(*groups).agg(F.count(F.lit(1)).alias("_good"), F.avg("u").alias("_mu"), F.avg("v").alias("_mv"))
    place = good.select(*groups, F.col("mid_x").alias("_gx"), F.col("mid_y").alias("_gy"), F.col("u").alias("_nu"), F.col("v").alias("_nv"))
    wrong = wrong.withColumns({"_wx": F.col("mid_x"), "_wy": F.col("mid_y")})
    near = N.nearest(wrong, place, groups, ["_wx", "_wy"], "mid_x", "mid_y", ["_nu", "_nv"], "_gx", "_gy").drop("d2")
    fixed = wrong.select(*groups, "_wx", "_wy").join(near, [*groups, "_wx", "_wy"], "left").join(means, list(groups), "left")
    fixed = fixed.select(*groups, "_wx", "_wy", *[F.when(F.col("_good") > 2, F.col(f"_n{c}")).otherwise(F.col(f"_m{c}")).alias(f"_f{c}") for c in "uv"])
    fixed = fixed.withColumnsRenamed({g: f"_{g}_" for g in groups})
    mine = reduce(lambda a, b: a & b, [F.col(g) == F.col(f"_{g}_") for g in groups]) & F.col("_bad") & (F.col("mid_x") == F.col("_wx")) & (F.col("mid_y") == F.col("_wy"))
    out = rows.join(fixed, mine, "left")
    return out.select(*[F.when(F.col("_bad"), F.col(f"_f{c}")).otherwise(F.col(c)).alias(c) if c in ("u", "v") else F.col(c) for c in samples.columns])


def boundary_flux(samples: DataFrame, by: Sequence[str], strict_against: DataFrame | None = None) -> DataFrame:
    """Inflow and outflow through boundary segments with sampled ``u, v``, outward normals and lengths.

    Segments without a sample are left out.  Given the expected number of segments
    per boundary (``keys, n_expected``), a group that misses one is NULL instead.
    """
    q = F.col("u") * F.col("nx") + F.col("v") * F.col("ny")
    rows = samples.withColumns({"_in": F.greatest(-q, q * 0.0) * F.col("length"), "_out": F.greatest(q, q * 0.0) * F.col("length")})
    g = rows.groupBy(*by).agg(F.sum("_in").alias("inflow"), F.sum("_out").alias("outflow"), F.count("_in").alias("n_segments"))
    if strict_against is None:
        return g
    on = [c for c in strict_against.columns if c != "n_expected"]
    whole = F.col("n_segments") == F.col("n_expected")
    g = g.join(strict_against, on)
    return g.withColumns({c: F.when(whole, F.col(c)) for c in ("inflow", "outflow")}).select(*by, "inflow", "outflow", "n_segments")


def conservation(flux: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals over all sides, net gain and the imbalance in percent of the traffic."""
    g = flux.groupBy(*by).agg(F.sum("inflow").alias("total_inflow"), F.sum("outflow").alias("total_outflow"))
    net = F.col("total_inflow") - F.col("total_outflow")
    return g.withColumns({"net": net, "error_pct": F.abs(net) / (F.col("total_inflow") + F.col("total_outflow") + 1e-10) * 100})


def vertical_integral(df: DataFrame, keys: Sequence[str], level: str, value: str, gravity: float = 9.80665) -> DataFrame:
    """Column integral ``(1/g) sum q dp`` by trapezoids between pressure levels (Pa)."""
    w = S.by(keys, level)
    piece = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(level) - F.lag(level).over(w))
    return df.withColumn("_p", piece).groupBy(*keys).agg((F.coalesce(F.sum("_p"), F.lit(0.0)) / gravity).alias("integral"))
