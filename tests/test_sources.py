"""Readers on files written here byte by byte, sinks and incremental runs."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans.base import REGISTRY
from tidemark.sources import files, formats, sinks, text
from tidemark.streaming import incremental


@pytest.fixture(scope="module")
def sources(spark):
    return formats.register(spark)


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Year;Value \n# note\n2000;1.5\n2001;NaN\n2002;x\n")
    df = text.read_csv_sniffed(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["year", "value"]
    got = text.coerce(df, {"year": "int", "value": "double"}).orderBy("year").collect()
    assert [tuple(r) for r in got] == [(2000, 1.5), (2001, None), (2002, None)]
    typed = text.read_csv(spark, str(tmp_path / "a.csv"), "y int, v double", sep=";", comment="#")
    assert typed.where("v IS NOT NULL").count() == 1
    (tmp_path / "w.txt").write_text("YR  MON ANOM\n 1950  1  -0.5 \n1950 2   0.7\n")
    rows = text.read_whitespace(spark, str(tmp_path / "w.txt"), ["y", "m", "v"], skip_pattern="^YR")
    assert [tuple(r) for r in rows.orderBy("m").collect()] == [("1950", "1", "-0.5"), ("1950", "2", "0.7")]


def test_schema_repair(spark):
    df = spark.createDataFrame([(1, 2.0)], "Net_Flux int, other double")
    default = spark.createDataFrame([(9,)], "netflux int")
    assert text.with_required(df, ["netflux"], default).first()[0] == 1
    assert text.with_required(df.drop("Net_Flux"), ["netflux"], default).first()[0] == 9
    assert text.alias_columns(df, {"flux": ["ivt", "net_flux"]}).columns == ["flux", "other"]
    fused = spark.createDataFrame([("a; 1",)], "row string")
    assert tuple(text.split_fused(fused, "row", ["k", "v"]).first()) == ("a", "1")


def test_file_listing(spark, tmp_path):
    for name in ("p202001.tif", "p202102.tif", "readme.txt"):
        (tmp_path / name).write_text("x")
    got = files.with_name_fields(files.list_files(spark, str(tmp_path), "*.tif"), "raster_month").orderBy("year")
    assert [(r["year"], r["month"]) for r in got.collect()] == [(2020, 1), (2021, 2)]


def write_zarr(root, data, times, lats, lons, chunks):
    def array(name, values, chunk, dims, attrs=None, compressor=None):
        folder = root / name
        folder.mkdir(parents=True)
        meta = {"zarr_format": 2, "shape": values.shape, "chunks": chunk, "dtype": values.dtype.str, "compressor": compressor, "fill_value": "NaN", "order": "C", "filters": None}
        (folder / ".zarray").write_text(json.dumps(meta))
        (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **(attrs or {})}))
        for index in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunk)]):
            block = np.full(chunk, np.nan if values.dtype.kind == "f" else 0, values.dtype)
            part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunk))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw = block.tobytes()
            (folder / ".".join(map(str, index))).write_bytes(zlib.compress(raw) if compressor else raw)

    (root / ".zgroup").parent.mkdir(parents=True, exist_ok=True)
    (root / ".zgroup").write_text('{"zarr_format": 2}')
    array("valid_time", times, (len(times),), ["valid_time"], {"units": "days since 2000-01-01"})
    array("latitude", lats, (len(lats),), ["latitude"])
    array("longitude", lons, (len(lons),), ["longitude"])
    array("tp", data, chunks, ["valid_time", "latitude", "longitude"], compressor={"id": "zlib", "level": 1})


def test_zarr_chunks(sources, tmp_path):
    data = np.arange(5 * 3 * 4, dtype="<f4").reshape(5, 3, 4)
    data[2, 1, 1] = np.nan
    write_zarr(tmp_path / "200001.zarr", data, np.arange(5, dtype="<i8"), np.array([43.0, 42, 41]), np.array([50.0, 51, 52, 53]), (2, 3, 3))
    df = sources.read.format("zarr").option("path", str(tmp_path / "200001.zarr")).load()
    assert df.rdd.getNumPartitions() == 6
    assert df.count() == 60 and df.where("tp IS NULL").count() == 1
    row = df.where("latitude = 42 AND longitude = 53 AND valid_time = timestamp_ntz'2000-01-04'").first()
    assert row["tp"] == data[3, 1, 3]


def netcdf_bytes(lat, lon, values):
    """A classic file with dimensions time (record), lat, lon and one variable per dimension plus t2m."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    text_attr = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + v.encode().ljust(-(-len(v) // 4) * 4, b"\0")
    n = values.shape[0]
    head = b"CDF\x01" + struct.pack(">i", n) + struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("lat") + struct.pack(">i", len(lat)) + name("lon") + struct.pack(">i", len(lon))
    head += struct.pack(">ii", 0, 0)
    specs = [("lat", [1], 5, "", 4 * len(lat)), ("lon", [2], 5, "", 4 * len(lon)), ("time", [0], 6, "days since 2001-01-01", 8), ("t2m", [0, 1, 2], 5, "", 4 * len(lat) * len(lon))]

    def build(begins):
        out = head + struct.pack(">ii", 11, len(specs))
        for (label, axes, kind, units, size), begin in zip(specs, begins):
            attrs = struct.pack(">ii", 12, 1) + text_attr("units", units) if units else struct.pack(">ii", 0, 0)
            out += name(label) + struct.pack(">i", len(axes)) + b"".join(struct.pack(">i", a) for a in axes) + attrs + struct.pack(">iii", kind, size, begin)
        return out

    base = len(build([0] * 4))
    begins = [base, base + specs[0][4], base + specs[0][4] + specs[1][4], base + specs[0][4] + specs[1][4] + 8]
    body = np.asarray(lat, ">f4").tobytes() + np.asarray(lon, ">f4").tobytes()
    for i in range(n):
        body += struct.pack(">d", i) + np.asarray(values[i], ">f4").tobytes()
    return build(begins) + body


def test_netcdf_records(sources, tmp_path):
    values = np.arange(3 * 2 * 2, dtype=float).reshape(3, 2, 2)
    (tmp_path / "T2m200101.nc").write_bytes(netcdf_bytes([42, 41], [50, 51], values))
    df = sources.read.format("netcdf").option("path", str(tmp_path)).option("rows", "2").load()
    assert df.rdd.getNumPartitions() == 2 and df.count() == 12
    assert df.where("lat = 41 AND lon = 50 AND time = timestamp_ntz'2001-01-03'").first()["t2m"] == values[2, 1, 0]
    assert files.with_name_fields(df, "netcdf_month").select("year", "month").distinct().collect() == [(2001, 1)]


def tiff_bytes(values, nodata=-9999.0):
    raw = zlib.compress(values.astype("<f4").tobytes())
    h, w = values.shape
    doubles = struct.pack("<3d", 0.5, 0.25, 0) + struct.pack("<6d", 0, 0, 0, 49.0, 43.0, 0) + b"-9999\0\0\0"
    at = 8 + len(raw) + len(raw) % 2
    rows = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 8), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, len(raw)), (339, 3, 1, 3)]
    rows += [(33550, 12, 3, at), (33922, 12, 6, at + 24), (42113, 2, 6, at + 72)]
    table = struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in rows) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", at + len(doubles)) + raw + b"\0" * (len(raw) % 2) + doubles + table


def test_geotiff(sources, tmp_path):
    values = np.array([[1.0, 2, 3], [4, -9999, 6]])
    (tmp_path / "p202003.tif").write_bytes(tiff_bytes(values))
    got = {(r["y"], r["x"]): r["value"] for r in sources.read.format("geotiff").option("path", str(tmp_path)).load().collect()}
    assert got[(42.875, 49.25)] == 1.0 and got[(42.625, 50.25)] == 6.0 and got[(42.625, 49.75)] is None


def test_shapefile(sources, tmp_path):
    def record(parts):
        points = [p for part in parts for p in part]
        starts = np.cumsum([0, *[len(p) for p in parts]])[:-1]
        body = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">ii", 1, len(body) // 2) + body

    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record([[(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6), (5, 6)]]) + record([[(9, 9), (8, 9)]]))
    df = sources.read.format("shapefile").option("path", str(tmp_path)).load()
    assert [tuple(r) for r in df.groupBy("shape", "part").count().orderBy("shape", "part").collect()] == [(0, 0, 3), (0, 1, 4), (1, 0, 2)]
    assert df.where("shape = 0 AND part = 1 AND seq = 2").select("lon", "lat").first() == (6.0, 6.0)


def test_workbook(sources, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{link}"><sheets><sheet name="S_1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>lon</t></si><si><t>lat</t></si></sst>")
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>51.5</v></c></row><row r="3"><c r="B3"><v>42</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    rows = sources.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).load().orderBy("row").collect()
    assert [tuple(r) for r in rows] == [("S_1", 1, "51.5", None), ("S_1", 2, None, "42")]
    bare = sources.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).option("header", "false").option("names", "x,y").load()
    assert bare.columns == ["sheet", "row", "x", "y"] and bare.count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.5, 2), ("c", None, 3)], "k string, v double, n int")
    sinks.write_csv(df, str(tmp_path / "out"), bom=True, index=["n"], single_file=True)
    part = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert part.startswith("﻿n,k,v".encode())
    table = sinks.latex_table(df, ["k"], ["v"], "Trends", ["k"])
    assert "a\\_b & 1.5000 \\\\" in table and "c & -- \\\\" in table
    assert df.select(sinks.persian_digits(F.lit("1990"))).first()[0] == "۱۹۹۰"
    assert df.select(sinks.report_number(F.lit(2.5e7))).first()[0] == "2.50e+07"
    sinks.write_sheets({"High": df, "Low": df.limit(1)}, str(tmp_path / "book"))
    assert spark.read.parquet(str(tmp_path / "book" / "Low")).count() == 1


def test_incremental_run_computes_once(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []

    def compute(todo):
        seen.append(todo.count())
        return todo.withColumn("v", F.col("m") * 10)

    tasks = spark.range(5).select(F.col("id").alias("m"))
    schema = "m long, v long"
    assert incremental.run_pending(tasks.where("m < 3"), store, ["m"], compute, schema).count() == 3
    assert incremental.run_pending(tasks, store, ["m"], compute, schema).count() == 5
    assert incremental.run_pending(tasks, store, ["m"], compute, schema).count() == 5
    assert seen == [3, 2, 0]
    merged = incremental.merge_results(spark.createDataFrame([(4, 1)], schema), store, ["m"], schema)
    assert merged.where("m = 4").first()["v"] == 1 and merged.count() == 5


def test_registry_is_complete():
    assert len(REGISTRY) > 150 and all(e.operators for e in REGISTRY.values())
