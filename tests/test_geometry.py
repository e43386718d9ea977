"""Rings, projections, grids and flux: invariants and analytic cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import kernels
from tidemark.operators import geo as G

GRID = G.Grid(40.0, 49.0, 0.25, 0.25, 17, 17)


def circle(spark, n=200, radius=1.0, reverse=False):
    angles = [2 * math.pi * i / n for i in range(n)]
    rows = [("c", n - 1 - i if reverse else i, 51 + radius * math.cos(a), 42 + radius * math.sin(a)) for i, a in enumerate(angles)]
    return spark.createDataFrame(rows, "ring string, seq long, lon double, lat double")


def field(spark, u, v):
    rows = [(iy, ix, float(u(40 + iy * 0.25, 49 + ix * 0.25)), float(v(40 + iy * 0.25, 49 + ix * 0.25))) for iy in range(17) for ix in range(17)]
    return spark.createDataFrame(rows, "iy long, ix long, u double, v double").withColumn("year", F.lit(2000))


@pytest.mark.parametrize("reverse", [False, True])
def test_uniform_flow_through_a_circle(spark, reverse):
    planar = circle(spark, reverse=reverse).withColumns({"x": F.col("lon") - 51, "y": F.col("lat") - 42})
    segs = G.segments(planar, ["ring"], "seq").withColumns({"u": F.lit(0.0), "v": F.lit(-1.0)})
    row = G.boundary_flux(segs, ["ring"]).first()
    assert row["inflow"] == pytest.approx(2.0, rel=0.02)
    assert row["outflow"] == pytest.approx(row["inflow"], abs=1e-12)


def test_affine_field_is_sampled_exactly_and_constant_field_is_conserved(spark):
    segs = G.segments(circle(spark, 60), ["ring"], "seq", C.EqualArea())
    corners = G.bilinear_corners(segs, GRID)
    got = G.bilinear_sample(corners, field(spark, lambda la, lo: 2 + 3 * la - lo, lambda la, lo: 7.0), ["ring", "seq"], ["year"], ["u", "v"]).toPandas()
    assert len(got) == 60
    assert np.allclose(got["u"], 2 + 3 * got["mid_lat"] - got["mid_lon"])
    still = G.bilinear_sample(corners, field(spark, lambda la, lo: 4.0, lambda la, lo: -3.0), ["ring", "seq"], ["year"], ["u", "v"])
    total = G.conservation(G.boundary_flux(still, ["ring"]), ["ring"]).first()
    assert abs(total["net"]) < 1e-6 * total["total_inflow"]


def test_missing_corners_give_null_and_strict_flux_notices(spark):
    segs = G.segments(circle(spark, 60), ["ring"], "seq", C.EqualArea())
    flat = field(spark, lambda la, lo: 1.0, lambda la, lo: 1.0)
    got = G.bilinear_sample(G.bilinear_corners(segs, GRID), flat.where("iy > 8"), ["ring", "seq"], ["year"], ["u", "v"])
    assert 0 < got.where("u IS NULL").count() < 8 and got.count() < 60
    full = G.bilinear_sample(G.bilinear_corners(segs, GRID), flat, ["ring", "seq"], ["year"], ["u", "v"])
    expected = segs.groupBy("ring").agg(F.count("*").alias("n_expected"))
    assert G.boundary_flux(got, ["ring", "year"], strict_against=expected).first()["inflow"] is None
    assert G.boundary_flux(got, ["ring", "year"]).first()["inflow"] > 0
    assert G.boundary_flux(full, ["ring", "year"], strict_against=expected).first()["inflow"] > 0


def test_projection_round_trip(spark):
    pts = spark.createDataFrame([(51.0, 42.0), (46.3, 36.1), (60.0, 55.5), (51.0, 60.0)], "lon double, lat double")
    p = C.EqualArea()
    back = p.unproject(p.project(pts), "x", "y", "lon2", "lat2").toPandas()
    assert np.allclose(back["lon"], back["lon2"], atol=1e-9) and np.allclose(back["lat"], back["lat2"], atol=1e-7)
    assert abs(back["x"][0]) < 1e-6 and abs(back["y"][0]) < 1e-6


def test_mask_matches_ray_casting(spark):
    rng = np.random.default_rng(4)
    angle = np.sort(rng.random(40) * 2 * np.pi)
    radius = 0.6 + rng.random(40)
    ring = np.column_stack([51 + radius * np.cos(angle), 42 + radius * np.sin(angle)])
    df = spark.createDataFrame([("p", i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "ring string, seq long, lon double, lat double")
    got = {(r["iy"], r["ix"]) for r in G.polygon_mask(df, ["ring"], "seq", GRID).collect()}
    nxt = np.roll(ring, -1, axis=0)

    def inside(x, y):
        cross = (ring[:, 1] > y) != (nxt[:, 1] > y)
        at = ring[:, 0] + (y - ring[:, 1]) * (nxt[:, 0] - ring[:, 0]) / np.where(cross, nxt[:, 1] - ring[:, 1], 1)
        return (cross & (at > x)).sum() % 2 == 1

    assert got == {(iy, ix) for iy in range(17) for ix in range(17) if inside(49 + ix * 0.25, 40 + iy * 0.25)}


def test_orientation_normals_and_resampling(spark):
    for reverse in (False, True):
        ring = circle(spark, 36, reverse=reverse)
        assert (G.signed_area(ring, ["ring"], "seq").first()["area"] < 0) == reverse
        assert G.signed_area(G.counter_clockwise(ring, ["ring"], "seq"), ["ring"], "seq").first()["area"] > 0
        n = G.vertex_normals(ring, ["ring"], "seq").toPandas()
        assert ((51 - n["lon"]) * n["nx"] + (42 - n["lat"]) * n["ny"] > 0).all()
    line = spark.createDataFrame([("l", 0, 50.0, 42.0), ("l", 1, 50.5, 42.0), ("l", 2, 50.5, 42.7)], "ring string, seq long, lon double, lat double")
    pts = G.resample(line, ["ring"], "seq", 5.0).orderBy("i").toPandas()
    total = G.arc_length(line, ["ring"], "seq").agg(F.max("arc_km")).first()[0]
    assert pts["i"].tolist() == list(range(int(total // 5) + 1))


def test_interior_point_of_a_crescent(spark):
    outer = [(math.cos(a), math.sin(a)) for a in np.linspace(0.4, 2 * math.pi - 0.4, 40)]
    inner = [(0.8 * x, 0.8 * y) for x, y in reversed(outer)]
    df = spark.createDataFrame([("m", i, float(x), float(y)) for i, (x, y) in enumerate(outer + inner)], "ring string, seq long, lon double, lat double")
    p = G.interior_point(df, ["ring"], "seq").first()
    assert not p["is_centroid"] and 0.8 <= math.hypot(p["lon"], p["lat"]) <= 1.0


def test_ring_kernels():
    angle = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    ring = np.column_stack([np.cos(angle), np.sin(angle)])
    fine = kernels.periodic_spline(ring, 300)
    assert np.abs(np.hypot(*fine.T) - 1).max() < 1e-3 and np.allclose(fine[0], fine[-1])
    t = np.linspace(0, 1, 10, endpoint=False)[:, None]
    corners = np.array([[0, 0], [4, 0], [4, 2], [0, 2.0]])
    box = np.vstack([a + t * (b - a) for a, b in zip(corners, np.roll(corners, -1, axis=0))])
    arc, how = kernels.ring_arcs(box)
    assert how == "rectangle" and np.bincount(arc).tolist() == [10, 10, 10, 10]
    assert kernels.ring_arcs(ring[:6])[1] == "even"


def test_outlier_repair(spark):
    pdf = pd.DataFrame({"ring": "r", "year": 2000, "seq": range(5), "mid_x": [0.0, 1, 2, 3, 4], "mid_y": 0.0, "u": [1.0, 2, 9999, 4, 5], "v": [1.0, 1, 1, 1, 1]})
    got = G.repair_outliers(spark.createDataFrame(pdf), ["ring", "year"]).orderBy("seq").toPandas()["u"].tolist()
    assert got[2] in (2.0, 4.0) and got[:2] + got[3:] == [1.0, 2.0, 4.0, 5.0]
    few = pdf.assign(u=[1.0, 3.0, 9999, 9999, 9999])
    assert G.repair_outliers(spark.createDataFrame(few), ["ring", "year"]).where("seq = 4").first()["u"] == 2.0


def test_nearest_vertex_searches_wider_until_found(spark):
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 30.0, 40.0)], "p long, lon double, lat double")
    vertices = spark.createDataFrame([(10, 0.0, 0.0), (11, 0.3, 0.1), (12, 1.0, 1.0)], "v long, lon double, lat double")
    got = {r["p"]: r["v"] for r in G.nearest_vertex(points, vertices, "p", "v", 1).collect()}
    assert got == {1: 10, 2: 12}


def test_nearest_vertex_without_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0)], "p long, lon double, lat double")
    vertices = spark.createDataFrame([(7, 1.0, 0.0), (8, None, None)], "v long, lon double, lat double")
    got = {r["p"]: (r["v"], r["distance"]) for r in G.nearest_vertex(points, vertices, "p", "v").collect()}
    assert got == {1: (7, 1.0), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize("dlat,dlon", [(1.0, 1.0), (-1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)])
def test_mask_on_grids_of_either_direction(spark, dlat, dlon):
    ring = spark.createDataFrame([("a", 0, 2.5, 2.5), ("a", 1, 7.5, 2.5), ("a", 2, 7.5, 7.5), ("a", 3, 2.5, 7.5)], "ring string, seq long, lon double, lat double")
    grid = G.Grid(0.0 if dlat > 0 else 9.0, 0.0 if dlon > 0 else 9.0, dlat, dlon, 10, 10)
    cells = {(grid.lat0 + r["iy"] * dlat, grid.lon0 + r["ix"] * dlon) for r in G.polygon_mask(ring, ["ring"], "seq", grid).collect()}
    assert cells == {(float(a), float(b)) for a in range(3, 8) for b in range(3, 8)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 50])
def test_cyclic_elimination(n):
    rng = np.random.default_rng(n)
    lower, upper = rng.uniform(0.1, 1, n), rng.uniform(0.1, 1, n)
    diagonal, right = 2 * (lower + upper), rng.normal(size=(n, 2))
    system = np.diag(diagonal)
    for i in range(n):
        system[i, (i + 1) % n] += upper[i]
        system[i, (i - 1) % n] += lower[i]
    assert np.allclose(kernels.cyclic_solve(lower, diagonal, upper, right), np.linalg.solve(system, right))
