"""A folder of array stores as one scan, and grids written as a store."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sources import write_zarr as store
from tidemark.sources import formats, stores


@pytest.fixture(scope="module")
def sources(spark):
    return formats.register(spark)


def folder(root, names):
    for k, name in enumerate(names):
        data = np.arange(5 * 3 * 4, dtype="<f4").reshape(5, 3, 4) + 100 * k
        store(root / name, data, np.arange(5, dtype="<i8"), np.array([43.0, 42, 41]), np.array([50.0, 51, 52, 53]), (2, 3, 3))


def test_stores_are_chosen_before_they_are_opened(spark, tmp_path):
    folder(tmp_path, ["200001.zarr", "200002.zarr", "200101.zarr", "extra.zarr"])
    (tmp_path / "200101.zarr" / "tp" / ".zarray").write_text("not a header")  # opening it fails
    (tmp_path / "notes.txt").write_text("x")
    listed = stores.list_stores(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in listed.orderBy("store").collect()] == [(2000, 1), (2000, 2), (2001, 1), (None, None)]
    df = stores.read_stores(listed.where("year = 2000"))
    assert df.columns == ["store", "year", "month", "valid_time", "latitude", "longitude", "tp"] and df.rdd.getNumPartitions() == 2
    got = df.groupBy("year", "month").agg(F.count("tp").alias("n"), F.max("tp").alias("m")).orderBy("month").collect()
    assert [tuple(r) for r in got] == [(2000, 1, 60, 59.0), (2000, 2, 60, 159.0)]
    one, two = (stores.read_stores(listed.where(f"month = {m} and year = 2000")) for m in (1, 2))
    assert sorted(r["month"] for r in one.union(two).select("month").distinct().collect()) == [1, 2]
    assert stores.read_stores(listed.where("year is null")).where("latitude = 42").count() == 20
    with pytest.raises(Exception, match="Expecting value"):
        stores.read_stores(listed).count()
    with pytest.raises(FileNotFoundError):
        stores.read_stores(listed.where("year = 1900"))


def test_slices_of_a_store(spark, tmp_path):
    folder(tmp_path, ["2003.zarr"])
    df = stores.read_stores(stores.list_stores(spark, str(tmp_path)), ["tp"], slices=4)
    assert df.rdd.getNumPartitions() == 4 and df.select("valid_time", "latitude", "longitude").distinct().count() == 60
    assert df.where("month is null and year = 2003").count() == 60


def test_zarr_write_round_trip(sources, spark, tmp_path):
    path, start = str(tmp_path / "grid.zarr"), datetime.datetime(2001, 3, 1, 6)
    rows = [(start + datetime.timedelta(hours=t), 40.0 - y, 50.0 + x / 4, float(t * 100 + y * 10 + x) if x else None, float(-x)) for t in range(7) for y in range(5) for x in range(6) if (t, y) != (3, 3)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, t2m double, u double")
    stores.write_zarr(df, path, {"time": 2, "lat": 2, "lon": 4}, ["t2m", "u"])
    back = spark.read.format("zarr").option("path", path).option("variables", "t2m,u").load()
    assert back.rdd.getNumPartitions() == 4 * 3 * 2 and back.count() == 7 * 5 * 6
    cells = back.join(df.withColumnsRenamed({"t2m": "a", "u": "b"}), ["time", "lat", "lon"])
    assert cells.count() == len(rows) and cells.where("t2m is distinct from a or u is distinct from b").count() == 0
    assert back.where("u is null").count() == 6
    with pytest.raises(FileExistsError):
        stores.write_zarr(df, path, {"time": 2, "lat": 2, "lon": 4}, ["u"])
    stores.write_zarr(df.where("lat > 38"), path, {"time": 100, "lat": 1, "lon": 100}, ["u"], overwrite=True)
    assert formats.ZarrStore(path).names() == ["lat", "lon", "time", "u"]
    assert spark.read.format("zarr").option("path", path).load().count() == 7 * 2 * 6


def test_zarr_write_leaves_no_store_on_failure(sources, spark, tmp_path):
    path = str(tmp_path / "grid.zarr")
    twice = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 1.0, 2.0), (1.0, 5.0, 1.0)], "y double, x double, v double")
    with pytest.raises(Exception, match="two rows for one cell"):
        stores.write_zarr(twice, path, {"y": 1, "x": 1}, ["v"])
    assert not formats.exists(f"{path}/.zgroup") and not formats.exists(f"{path}/v/.zarray")
    with pytest.raises(ValueError, match="NULL or NaN"):
        stores.write_zarr(spark.createDataFrame([(None, 1.0, 1.0)], "y double, x double, v double"), path, {"y": 1, "x": 1}, ["v"])
    stores.write_zarr(twice.where("v = 1"), path, {"y": 1, "x": 1}, ["v"])
    assert spark.read.format("zarr").option("path", path).load().where("v = 1").count() == 2
    stores.write_zarr(twice.limit(0), str(tmp_path / "none.zarr"), {"y": 1, "x": 1}, ["v"])
    assert formats.ZarrStore(str(tmp_path / "none.zarr")).names() == ["v", "x", "y"]


def test_long_netcdf_header(tmp_path, monkeypatch):
    from test_sources import netcdf_bytes

    path = tmp_path / "a.nc"
    monkeypatch.setattr(formats, "HEADER", 16)
    values = np.arange(2 * 2 * 3, dtype=">f4").reshape(2, 2, 3)
    path.write_bytes(netcdf_bytes(np.array([1, 2], ">f4"), np.array([1, 2, 3], ">f4"), values))
    assert sorted(formats.NetcdfFile(str(path)).variables) == ["lat", "lon", "t2m", "time"]
    path.write_bytes(path.read_bytes()[:60])
    with pytest.raises(ValueError, match="within its header"):
        formats.NetcdfFile(str(path))
