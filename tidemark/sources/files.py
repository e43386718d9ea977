"""Directory listings and the facts file names carry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C

# File-name patterns of the monthly and annual stores.
NAME_PATTERNS = {
    "zarr_month": (r"(\d{4})(\d{2})\.zarr", {"year": "long", "month": "long"}),
    "zarr_year": (r"(\d{4})\.zarr", {"year": "long"}),
    "raster_month": (r"p(\d{4})(\d{2})\.tif", {"year": "long", "month": "long"}),
    "netcdf_month": (r"T2m(\d{4})(\d{2})\.nc", {"year": "long", "month": "long"}),
    "side_series": (r"([^/_]+)_([^/_]+)_([^/_]+)\.csv", {"boundary": "string", "side": "string", "flow": "string"}),
}


def name_fields(path: C.ColumnLike, pattern: str, fields: Mapping[str, str]) -> list[Column]:
    """Groups of a file-name pattern as typed columns; NULL where the name does not match."""
    path = C.col(path)
    return [F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")).try_cast(t).alias(n) for i, (n, t) in enumerate(fields.items())]


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Paths, sizes and times of files; contents stay unread because the column is pruned."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def with_name_fields(df: DataFrame, kind: str, path: str = "path") -> DataFrame:
    pattern, fields = NAME_PATTERNS[kind]
    return df.select("*", *name_fields(path, pattern, fields))


def read_with_name_fields(df: DataFrame, kind: str) -> DataFrame:
    """Rows of a multi-file scan with the fields of the file each row came from."""
    return with_name_fields(df.withColumn("path", F.input_file_name()), kind).drop("path")
