"""Readers for array, raster, polygon and workbook files, as Spark data sources.

Each plans one task per chunk, slab, block run, file or sheet, and yields Arrow
batches, so a store of any size is read in parallel and a task holds one piece.
Register them with :func:`register` and use ``spark.read.format("zarr")`` etc.
"""

from __future__ import annotations

import datetime
import gzip
import itertools
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()


def find_files(path: str, suffix: str) -> list[str]:
    """The path itself, or the matching files below a folder."""
    fs, p = _open(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(p, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix))


def exists(path: str) -> bool:
    fs, p = _open(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def decode_time(values: np.ndarray, units: str | None) -> np.ndarray:
    """``<step> since <date>`` numbers to timestamps."""
    match = re.match(r"(\w+) since (\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?", units or "")
    if not match:
        return values
    origin = np.datetime64(datetime.datetime(*(int(g or 0) for g in match.groups()[1:])), "us")
    unit = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000}[match[1][0].lower()]
    return origin + np.round(np.asarray(values, float) * unit).astype("timedelta64[us]")


def cells(dims: list[str], axes: list[np.ndarray], data: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per cell of a block: its coordinates, then the variables; NaN becomes NULL."""
    grid = np.meshgrid(*axes, indexing="ij")
    arrays = [pa.array(g.ravel()) for g in grid] + [pa.array(v.astype(float).ravel(), from_pandas=True) for v in data.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*dims, *data])


def cell_schema(dims: list[str], timed: set[str], variables: list[str]) -> StructType:
    fields = [StructField(d, TimestampNTZType() if d in timed else DoubleType()) for d in dims]
    return StructType([*fields, *[StructField(v, DoubleType()) for v in variables]])


class Piece(InputPartition):
    """A picklable unit of reading."""

    def __init__(self, **fields):
        self.__dict__.update(fields)


# ------------------------------------------------------------------ chunked arrays (zarr, format 2)


class ZarrStore:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def meta(self, name: str) -> dict:
        array = json.loads(read_bytes(f"{self.path}/{name}/.zarray"))
        attrs = f"{self.path}/{name}/.zattrs"
        return {**array, "attrs": json.loads(read_bytes(attrs)) if exists(attrs) else {}}

    def names(self) -> list[str]:
        fs, p = _open(self.path)
        return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(p)) if f.type == pafs.FileType.Directory and exists(f"{self.path}/{f.base_name}/.zarray"))

    def chunk(self, name: str, meta: dict, index: tuple[int, ...]) -> np.ndarray:
        """A whole chunk, trimmed to the array; absent chunks hold the fill value."""
        file = f"{self.path}/{name}/{meta.get('dimension_separator', '.').join(map(str, index))}"
        shape, fill = tuple(meta["chunks"]), meta.get("fill_value")
        if exists(file):
            raw, codec = read_bytes(file), (meta.get("compressor") or {}).get("id")
            if codec in ("zlib", "gzip"):
                raw = zlib.decompress(raw) if codec == "zlib" else gzip.decompress(raw)
            elif codec == "zstd":
                import zstandard

                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif codec:
                raise ValueError(f"zarr codec {codec} is not available; rewrite the store with zlib or zstd")
            block = np.frombuffer(raw, dtype=meta["dtype"]).reshape(shape, order=meta.get("order", "C"))
        else:
            block = np.full(shape, np.nan if fill in (None, "NaN") else fill, dtype=meta["dtype"])
        return block[tuple(slice(0, min(c, n - i * c)) for c, n, i in zip(shape, meta["shape"], index))]

    def whole(self, name: str) -> np.ndarray:
        meta = self.meta(name)
        return np.concatenate([self.chunk(name, meta, (i,)) for i in range(-(-meta["shape"][0] // meta["chunks"][0]))])


class ZarrSource(DataSource):
    """Options: ``path`` (a store, or several separated by commas), ``variables``."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _plan(self):
        paths = [p.strip() for p in self.options["path"].split(",")]
        store = ZarrStore(paths[0])
        metas = {n: store.meta(n) for n in store.names()}
        wanted = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]
        variables = wanted or [n for n, m in metas.items() if len(m["shape"]) > 1]
        dims = metas[variables[0]]["attrs"]["_ARRAY_DIMENSIONS"]
        timed = {d for d in dims if d in metas and " since " in metas[d]["attrs"].get("units", "")}
        return paths, variables, dims, timed

    def schema(self) -> StructType:
        _, variables, dims, timed = self._plan()
        return cell_schema(dims, timed, variables)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZarrReader(*self._plan()[:3])


class ZarrReader(DataSourceReader):
    def __init__(self, paths: list[str], variables: list[str], dims: list[str]):
        self.paths, self.variables, self.dims = paths, variables, dims

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            meta = ZarrStore(path).meta(self.variables[0])
            counts = [-(-n // c) for n, c in zip(meta["shape"], meta["chunks"])]
            out += [Piece(path=path, index=index) for index in itertools.product(*map(range, counts))]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        store = ZarrStore(partition.path)
        metas = {v: store.meta(v) for v in self.variables}
        first = metas[self.variables[0]]
        axes = []
        for d, c, i, n in zip(self.dims, first["chunks"], partition.index, first["shape"]):
            axis, attrs = store.whole(d), store.meta(d)["attrs"]
            axes.append(decode_time(axis[i * c : min((i + 1) * c, n)], attrs.get("units")))
        data = {}
        for v, m in metas.items():
            if m["chunks"] != first["chunks"] or m["shape"] != first["shape"]:
                raise ValueError(f"variable {v} is chunked differently from {self.variables[0]}")
            block = store.chunk(v, m, partition.index).astype(float)
            if isinstance(m.get("fill_value"), (int, float)):
                block[block == m["fill_value"]] = np.nan
            data[v] = block * m["attrs"].get("scale_factor", 1.0) + m["attrs"].get("add_offset", 0.0)
        yield cells(self.dims, [a if a.dtype.kind == "M" else a.astype(float) for a in axes], data)


# ------------------------------------------------------------------ NetCDF (classic formats)

# External types of the classic format, by type code.
NETCDF_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


#: Bytes of a header that are read first.
HEADER = 1 << 16


class NetcdfFile:
    """Header of a classic NetCDF file: dimensions, variables and where their values lie."""

    def __init__(self, path: str):
        self.path = path
        self._raw, self._at = b"", 0
        head = self._bytes(4)
        if head[:3] != b"CDF":
            raise ValueError(f"{path} is not a classic NetCDF file; convert NetCDF-4 with nccopy -k classic")
        self.version = head[3]
        wide = self.version == 5
        self._count = ">q" if wide else ">i"
        self.records = self._number()
        self.dims = [(self._name(), self._number()) for _ in range(self._list())]
        self.attrs = self._attributes()
        self.variables = {}
        for _ in range(self._list()):
            name = self._name()
            axes = [self._number() for _ in range(self._number())]
            attrs = self._attributes()
            kind = self._take(">i")
            size = self._number()
            begin = self._take(">i" if self.version == 1 else ">q")
            self.variables[name] = {"axes": axes, "attrs": attrs, "dtype": np.dtype(NETCDF_TYPES[kind]), "size": size, "begin": begin}
        record = [v for v in self.variables.values() if self._is_record(v)]
        self.record_size = sum(v["size"] for v in record)
        if len(record) == 1:  # a lone record variable is not padded
            v = record[0]
            self.record_size = v["dtype"].itemsize * int(np.prod([self.dims[a][1] for a in v["axes"][1:]]))

    def _bytes(self, n: int) -> bytes:
        """The next bytes of the header, of which more is read as it is needed, each time twice as much."""
        while self._at + n > len(self._raw):
            more = read_bytes(self.path, len(self._raw), max(HEADER, len(self._raw)))
            if not more:
                raise ValueError(f"{self.path} ends within its header")
            self._raw += more
        self._at += n
        return self._raw[self._at - n : self._at]

    def _take(self, fmt: str):
        return struct.unpack(fmt, self._bytes(struct.calcsize(fmt)))[0]

    def _number(self) -> int:
        return self._take(self._count)

    def _list(self) -> int:
        self._take(">i")
        return self._number()

    def _name(self) -> str:
        n = self._number()
        return self._bytes(-(-n // 4) * 4)[:n].decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind = self._name(), self._take(">i")
            n, dtype = self._number(), np.dtype(NETCDF_TYPES[kind])
            raw = self._bytes(-(-n * dtype.itemsize // 4) * 4)[: n * dtype.itemsize]
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out

    def _is_record(self, v: dict) -> bool:
        return bool(v["axes"]) and self.dims[v["axes"][0]][1] == 0

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dims[a][1] or self.records for a in self.variables[name]["axes"])

    def read(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Rows ``start:stop`` of the leading dimension."""
        v, shape = self.variables[name], self.shape(name)
        if not shape:
            return np.frombuffer(read_bytes(self.path, v["begin"], v["dtype"].itemsize), v["dtype"])
        stop = shape[0] if stop is None else stop
        row = int(np.prod(shape[1:])) * v["dtype"].itemsize
        if self._is_record(v):
            raw = b"".join(read_bytes(self.path, v["begin"] + i * self.record_size, row) for i in range(start, stop))
        else:
            raw = read_bytes(self.path, v["begin"] + start * row, (stop - start) * row)
        return np.frombuffer(raw, v["dtype"]).reshape((stop - start, *shape[1:]))


class NetcdfSource(DataSource):
    """Options: ``path`` (file or folder), ``variables``, ``rows`` (leading-dimension rows per task)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _plan(self):
        files = find_files(self.options["path"], ".nc")
        first = NetcdfFile(files[0])
        names = {d for d, _ in first.dims}
        wanted = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]
        variables = wanted or [n for n, v in first.variables.items() if n not in names and v["axes"] and v["dtype"].kind != "S"]
        dims = [first.dims[a][0] for a in first.variables[variables[0]]["axes"]]
        timed = {d for d in dims if d in first.variables and " since " in str(first.variables[d]["attrs"].get("units", ""))}
        return files, variables, dims, timed

    def schema(self) -> StructType:
        _, variables, dims, timed = self._plan()
        return cell_schema(dims, timed, variables).add("path", StringType())

    def reader(self, schema: StructType) -> DataSourceReader:
        files, variables, dims, _ = self._plan()
        return NetcdfReader(files, variables, dims, int(self.options.get("rows", "32")))


class NetcdfReader(DataSourceReader):
    def __init__(self, files: list[str], variables: list[str], dims: list[str], rows: int):
        self.files, self.variables, self.dims, self.rows = files, variables, dims, rows

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in self.files:
            n = NetcdfFile(f).shape(self.variables[0])[0]
            out += [Piece(path=f, start=i, stop=min(i + self.rows, n)) for i in range(0, n, self.rows)]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        file = NetcdfFile(partition.path)
        axes = []
        for k, d in enumerate(self.dims):
            span = (partition.start, partition.stop) if k == 0 else (0, None)
            if d in file.variables:
                axes.append(decode_time(file.read(d, *span).astype(float), file.variables[d]["attrs"].get("units")))
            else:
                axes.append(np.arange(span[0], file.shape(self.variables[0])[k] if span[1] is None else span[1], dtype=float))
        data = {}
        for v in self.variables:
            a = file.variables[v]["attrs"]
            block = file.read(v, partition.start, partition.stop).astype(float)
            for key in ("_FillValue", "missing_value"):
                if key in a:
                    block = np.where(block == a[key][0], np.nan, block)
            data[v] = block * a.get("scale_factor", [1.0])[0] + a.get("add_offset", [0.0])[0]
        batch = cells(self.dims, axes, data)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([partition.path] * batch.num_rows)], names=[*batch.schema.names, "path"])


# ------------------------------------------------------------------ GeoTIFF

# Tag numbers and field types of the format.
TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_COMPRESSION, TIFF_STRIPS, TIFF_STRIP_ROWS, TIFF_STRIP_BYTES = 256, 257, 258, 259, 273, 278, 279
TIFF_TILE_WIDTH, TIFF_TILE_HEIGHT, TIFF_TILES, TIFF_TILE_BYTES, TIFF_SAMPLE_FORMAT, TIFF_PREDICTOR, TIFF_SAMPLES = 322, 323, 324, 325, 339, 317, 277
TIFF_SCALE, TIFF_TIEPOINT, TIFF_NODATA = 33550, 33922, 42113
TIFF_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


class TiffFile:
    """First image of a (single-band) TIFF: geometry, block layout and georeference."""

    def __init__(self, path: str):
        self.path = path
        head = read_bytes(path, 0, 8)
        self.endian = "<" if head[:2] == b"II" else ">"
        if struct.unpack_from(self.endian + "H", head, 2)[0] != 42:
            raise ValueError(f"{path} is not a classic TIFF file")
        at = struct.unpack_from(self.endian + "I", head, 4)[0]
        n = struct.unpack(self.endian + "H", read_bytes(path, at, 2))[0]
        table = read_bytes(path, at + 2, 12 * n)
        self.tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(self.endian + "HHI", table, 12 * i)
            if kind not in TIFF_FIELDS:
                continue
            fmt = f"{self.endian}{count * len(TIFF_FIELDS[kind])}{TIFF_FIELDS[kind][0]}"
            size = struct.calcsize(fmt)
            raw = table[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else read_bytes(path, struct.unpack_from(self.endian + "I", table, 12 * i + 8)[0], size)
            self.tags[tag] = struct.unpack(fmt, raw)
        t = self.tags
        if t.get(TIFF_SAMPLES, (1,))[0] != 1:
            raise ValueError("only single-band rasters are read")
        self.width, self.height = t[TIFF_WIDTH][0], t[TIFF_HEIGHT][0]
        kind = {1: "u", 2: "i", 3: "f"}[t.get(TIFF_SAMPLE_FORMAT, (1,))[0]]
        self.dtype = np.dtype(f"{self.endian}{kind}{t[TIFF_BITS][0] // 8}")
        self.tiled = TIFF_TILES in t
        self.block_w = t[TIFF_TILE_WIDTH][0] if self.tiled else self.width
        self.block_h = t[TIFF_TILE_HEIGHT][0] if self.tiled else t.get(TIFF_STRIP_ROWS, (self.height,))[0]
        self.offsets = t[TIFF_TILES] if self.tiled else t[TIFF_STRIPS]
        self.sizes = t[TIFF_TILE_BYTES] if self.tiled else t[TIFF_STRIP_BYTES]
        nodata = b"".join(t[TIFF_NODATA]).split(b"\0")[0].decode() if TIFF_NODATA in t else ""
        self.nodata = float(nodata) if nodata.strip() else None

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell-centre x, cell-centre y and values of block ``i``."""
        raw, codec = read_bytes(self.path, self.offsets[i], self.sizes[i]), self.tags.get(TIFF_COMPRESSION, (1,))[0]
        if codec in (8, 32946):
            raw = zlib.decompress(raw)
        elif codec != 1:
            raise ValueError(f"TIFF compression {codec} is not available; rewrite with deflate or none")
        across = -(-self.width // self.block_w)
        row, column = (i // across) * self.block_h, (i % across) * self.block_w
        values = np.frombuffer(raw, self.dtype)
        values = values.reshape(-1, self.block_w)
        predictor = self.tags.get(TIFF_PREDICTOR, (1,))[0]
        if predictor == 2:
            values = np.cumsum(values, axis=1, dtype=self.dtype)
        elif predictor != 1:
            raise ValueError("floating-point predictors are not read")
        values = values[: min(self.block_h, self.height - row), : self.width - column].astype(float)
        if self.nodata is not None:
            values = np.where(values == self.nodata, np.nan, values)
        sx, sy = self.tags.get(TIFF_SCALE, (1.0, 1.0))[:2]
        ti, tj, _, tx, ty, _ = self.tags.get(TIFF_TIEPOINT, (0, 0, 0, 0.0, 0.0, 0))[:6]
        x = tx + (column + np.arange(values.shape[1]) + 0.5 - ti) * sx
        y = ty - (row + np.arange(values.shape[0]) + 0.5 - tj) * sy
        return x, y, values


class TiffSource(DataSource):
    """Options: ``path`` (file or folder), ``blocks`` (strips or tiles per task)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> StructType:
        return StructType([StructField("y", DoubleType()), StructField("x", DoubleType()), StructField("value", DoubleType()), StructField("path", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return TiffReader(find_files(self.options["path"], ".tif"), int(self.options.get("blocks", "64")))


class TiffReader(DataSourceReader):
    def __init__(self, files: list[str], blocks: int):
        self.files, self.blocks = files, blocks

    def partitions(self) -> list[InputPartition]:
        return [Piece(path=f, start=i, stop=i + self.blocks) for f in self.files for i in range(0, len(TiffFile(f).offsets), self.blocks)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        file = TiffFile(partition.path)
        for i in range(partition.start, min(partition.stop, len(file.offsets))):
            x, y, values = file.block(i)
            batch = cells(["y", "x"], [y, x], {"value": values})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([partition.path] * batch.num_rows)], names=["y", "x", "value", "path"])


# ------------------------------------------------------------------ polygon shapefiles


class ShapeSource(DataSource):
    """Vertices of polygon and polyline shapefiles: ``shape, part, seq, lon, lat, path``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        whole = [StructField(n, LongType()) for n in ("shape", "part", "seq")]
        return StructType([*whole, StructField("lon", DoubleType()), StructField("lat", DoubleType()), StructField("path", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapeReader(find_files(self.options["path"], ".shp"))


class ShapeReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [Piece(path=f) for f in self.files]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, p = _open(partition.path)
        with fs.open_input_file(p) as f:
            f.seek(100)
            shape = 0
            while len(head := f.read(8)) == 8:
                body = f.read(2 * struct.unpack(">ii", head)[1])
                if struct.unpack_from("<i", body)[0] in (3, 5, 13, 15, 23, 25):
                    parts, points = struct.unpack_from("<ii", body, 36)
                    starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
                    xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
                    sizes = np.diff(starts)
                    columns = [
                        pa.array(np.full(points, shape)),
                        pa.array(np.repeat(np.arange(parts), sizes)),
                        pa.array(np.concatenate([np.arange(s) for s in sizes])),
                        pa.array(xy[:, 0]),
                        pa.array(xy[:, 1]),
                        pa.array([partition.path] * points),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["shape", "part", "seq", "lon", "lat", "path"])
                shape += 1


# ------------------------------------------------------------------ workbooks

SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Workbook:
    def __init__(self, path: str):
        import io

        self.zip = zipfile.ZipFile(io.BytesIO(read_bytes(path)))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        sheets = ET.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{SHEET_NS}sheet")
        self.sheets = {s.get("name"): "xl/" + links[s.get(f"{LINK_NS}id")].removeprefix("/xl/") for s in sheets}

    def rows(self, sheet: str) -> Iterator[dict[int, str]]:
        """Cells of each row by column number, as text."""
        shared = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET_NS}t")) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml"))]
        for row in ET.fromstring(self.zip.read(self.sheets[sheet])).iter(f"{SHEET_NS}row"):
            out = {}
            for i, c in enumerate(row.iter(f"{SHEET_NS}c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters[0]))) - 1 if letters else i
                v = c.find(f"{SHEET_NS}v")
                if c.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{SHEET_NS}t"))
                elif v is not None and v.text is not None:
                    out[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield out


class WorkbookSource(DataSource):
    """Options: ``path`` (file or folder), ``sheets``, ``header`` (true), ``names`` for sheets without a header.

    Cells come as text with their ``sheet`` and ``row``; cast them afterwards.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _plan(self):
        files = find_files(self.options["path"], ".xlsx")
        book = Workbook(files[0])
        wanted = [s.strip() for s in self.options.get("sheets", "").split(",") if s.strip()] or list(book.sheets)
        header = self.options.get("header", "true").lower() == "true"
        if header:
            first = next(book.rows(wanted[0]), {})
            names = [first.get(i, f"c{i}").strip() for i in range(max(first, default=-1) + 1)]
        else:
            names = [n.strip() for n in self.options["names"].split(",")]
        return files, wanted, header, names

    def schema(self) -> StructType:
        names = self._plan()[3]
        return StructType([StructField("sheet", StringType()), StructField("row", IntegerType()), *[StructField(n, StringType()) for n in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(*self._plan())


class WorkbookReader(DataSourceReader):
    def __init__(self, files: list[str], sheets: list[str], header: bool, names: list[str]):
        self.files, self.sheets, self.header, self.names = files, sheets, header, names

    def partitions(self) -> list[InputPartition]:
        return [Piece(path=f, sheet=s) for f in self.files for s in self.sheets]

    def read(self, partition) -> Iterator[tuple]:
        for i, cell in enumerate(Workbook(partition.path).rows(partition.sheet)):
            if not (self.header and i == 0):
                yield (partition.sheet, i, *[cell.get(k) for k in range(len(self.names))])


def register(spark: SparkSession) -> SparkSession:
    for source in (ZarrSource, NetcdfSource, TiffSource, ShapeSource, WorkbookSource):
        spark.dataSource.register(source)
    return spark
