"""Chunked array stores as tables: a folder of stores read as one scan, and grids written as a store.

:func:`list_stores` makes a table of the stores and of what their names say, :func:`read_stores` reads those that are left of
it after any filter or join. :func:`write_zarr` writes a table of cells as one store.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from tidemark.sources.formats import ZarrReader, ZarrSource, _open, exists

NAME = r"(?P<year>\d{4})(?P<month>\d{2})?\.zarr$"


def list_stores(spark: SparkSession, folder: str, pattern: str = NAME) -> DataFrame:
    """``store`` and one whole number for each named group of ``pattern``, NULL where a name does not match.

    Only the folder itself is listed: no store is opened, and nothing inside one is looked at.
    """
    fs, p = _open(folder)
    found = fs.get_file_info(pafs.FileSelector(p))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.endswith(".zarr"))
    fields = list(re.compile(pattern).groupindex)
    rows = []
    for name in names:
        match = re.search(pattern, name)
        rows.append((f"{folder.rstrip('/')}/{name}", *[int(match[f]) if match and match[f] else None for f in fields]))
    return spark.createDataFrame(rows, StructType([StructField("store", StringType()), *[StructField(f, LongType()) for f in fields]]))


def read_stores(stores: DataFrame, variables: Sequence[str] = (), slices: int = 1) -> DataFrame:
    """The cells of every store of ``stores``, each beside all columns of its row; filter that table to leave stores unopened.

    A store is read by ``slices`` tasks, a chunk at a time. The header of the first store gives the schema; those of the
    others are read in the tasks, and a store with other columns is an error. Without a store there is no schema, which is an error.

    The stores are chosen in the table of their names and not by filters pushed into a Python data source: Spark 4.1 keeps one
    plan of the reader for a relation, so two filters on it in one query would both read what the later one chose.
    """
    first = stores.agg(F.min("store").alias("s")).first()["s"]
    if first is None:
        raise FileNotFoundError("no store to read")
    source = lambda path, wanted: ZarrSource({"path": path, "variables": ",".join(wanted)})
    held = source(first, variables).schema()
    cells_of, own_columns = [f.name for f in held.fields], stores.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, at = row.column("store")[0].as_py(), row.column("_slice")[0].as_py()
                _, found, dims, _ = source(path, variables)._plan()
                if [*dims, *found] != cells_of:
                    raise ValueError(f"{path} holds {[*dims, *found]}, {first} holds {cells_of}")
                reader = ZarrReader([path], found, dims)
                for piece in itertools.islice(reader.partitions(), at, None, slices):
                    for part in reader.read(piece):
                        same = pa.array(np.zeros(part.num_rows, np.int32))
                        own = [row.column(c).take(same) for c in own_columns]
                        yield pa.RecordBatch.from_arrays([*own, *part.columns], names=[*own_columns, *cells_of])

    tasks = stores.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return tasks.repartition(max(1, tasks.count())).mapInArrow(read, StructType([*stores.schema.fields, *held.fields]))


# ------------------------------------------------------------------ writing


@dataclass
class Written(ds.WriterCommitMessage):
    chunks: int


def _put(path: str, content: bytes) -> None:
    """A whole file or none: another attempt of the task replaces it by the same content."""
    fs, p = _open(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    own = f"{p}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as f:
        f.write(content)
    fs.move(own, p)


class ZarrGridSource(ds.DataSource):
    """The sink behind :func:`write_zarr`."""

    @classmethod
    def name(cls) -> str:
        return "zarr_grid"

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceArrowWriter:
        return ZarrGridWriter(self.options["path"], json.loads(self.options["layout"]))


class ZarrGridWriter(ds.DataSourceArrowWriter):
    """Rows ``_chunk, _cell`` and the variables, chunk by chunk; a task holds one chunk.

    Only the commit writes metadata, so what a failed job leaves is not a store.
    """

    def __init__(self, path: str, layout: dict):
        self.path, self.layout = path, layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        variables, size, count = self.layout["variables"], math.prod(self.layout["chunks"]), 0
        current, block, filled = None, None, None
        for batch in iterator:
            at, cell = batch.column("_chunk").to_numpy(), batch.column("_cell").to_numpy()
            values = [batch.column(v).to_numpy(zero_copy_only=False) for v in variables]
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)] if len(at) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if at[a] != current:
                    count += self._flush(current, block)
                    current, block, filled = int(at[a]), np.full((len(variables), size), np.nan), np.zeros(size, bool)
                some = cell[a:b]
                if filled[some].any() or len(np.unique(some)) < len(some):
                    raise ValueError(f"two rows for one cell of chunk {current}")
                filled[some] = True
                for row, v in zip(block, values):
                    row[some] = v[a:b]
        return Written(count + self._flush(current, block))

    def _flush(self, chunk: int | None, block: np.ndarray | None) -> int:
        if chunk is None:
            return 0
        counts = [-(-n // c) for n, c in zip(self.layout["shape"], self.layout["chunks"])]
        name = ".".join(map(str, np.unravel_index(chunk, counts)))
        for variable, row in zip(self.layout["variables"], block):
            _put(f"{self.path}/{variable}/{name}", zlib.compress(row.astype("<f8").tobytes(), 1))
        return 1

    def commit(self, messages: list[Written | None]) -> None:
        dims, shape, chunks, units = (self.layout[k] for k in ("dims", "shape", "chunks", "units"))
        for d, n in zip(dims, shape):
            self._describe(d, [n], [n], [d], {"units": units[d]} if d in units else {})
        for v in self.layout["variables"]:
            self._describe(v, shape, chunks, dims, {})
        _put(f"{self.path}/.zgroup", json.dumps({"zarr_format": 2}).encode())

    def _describe(self, name: str, shape: list[int], chunks: list[int], dims: list[str], attrs: dict) -> None:
        meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}
        _put(f"{self.path}/{name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims, **attrs}).encode())
        _put(f"{self.path}/{name}/.zarray", json.dumps(meta).encode())

    def abort(self, messages: list[Written | None]) -> None:
        clear(self.path)


def clear(path: str) -> None:
    fs, p = _open(path)
    fs.delete_dir_contents(p, missing_dir_ok=True)


def write_zarr(df: DataFrame, path: str, dims: Mapping[str, int], variables: Sequence[str], overwrite: bool = False) -> None:
    """Write the cells of ``df`` as a store; ``dims`` gives each coordinate column and the cells of a chunk along it.

    Rows meet by the chunk they lie in, so a task needs memory for one chunk, and absent chunks make no file. Cells
    without a row are NaN, and so are NULL values; two rows for a cell or a coordinate that is NULL or NaN are an error. Times
    are kept as seconds since 1970. An axis passes the driver whole, as every reader of a store holds the axes whole.
    """
    if exists(f"{path}/.zgroup") and not overwrite:
        raise FileExistsError(f"{path} is a store")
    spark, kinds = df.sparkSession, {f.name: f.dataType for f in df.schema.fields}
    units = {d: "seconds since 1970-01-01" for d in dims if isinstance(kinds[d], (DateType, TimestampType, TimestampNTZType))}
    number = lambda d: (
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(d).cast("timestamp_ntz")) / 1e6 if d in units else F.col(d).cast("double")
    )
    rows = df.select(*[number(d).alias(f"_d{i}") for i, d in enumerate(dims)], *[F.col(v).cast("double").alias(v) for v in variables])
    axes = {}
    for i, d in enumerate(dims):
        axes[d] = np.sort(rows.select(f"_d{i}").distinct().toPandas()[f"_d{i}"].to_numpy(float))
        if np.isnan(axes[d]).any():
            raise ValueError(f"{d} is NULL or NaN in some row")
    clear(path)
    shape, chunks = [len(axes[d]) for d in dims], [max(1, min(c, len(axes[d]))) for d, c in dims.items()]
    for i, (d, axis) in enumerate(axes.items()):
        _put(f"{path}/{d}/0", zlib.compress(axis.astype("<f8").tobytes(), 1))
        place = spark.createDataFrame(pd.DataFrame({f"_d{i}": axis, f"_i{i}": np.arange(len(axis))}), f"_d{i} double, _i{i} long")
        rows = rows.join(place, f"_d{i}")
    chunk, cell = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, (n, c) in enumerate(zip(shape, chunks)):
        chunk = chunk * -(-n // c) + F.floor(F.col(f"_i{i}") / c)
        cell = cell * c + F.col(f"_i{i}") % c
    layout = {"dims": list(dims), "shape": shape, "chunks": chunks, "units": units, "variables": list(variables)}
    placed = rows.select(chunk.cast("long").alias("_chunk"), cell.cast("long").alias("_cell"), *variables)
    dealt = placed.repartition("_chunk").sortWithinPartitions("_chunk")
    spark.dataSource.register(ZarrGridSource)
    dealt.write.format("zarr_grid").mode("append").option("path", path).option("layout", json.dumps(layout)).save()

