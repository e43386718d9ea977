"""Delimited text: typed scans, delimiter detection, comments, whitespace tables, schema repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidemark.functions import columns as C
from tidemark.operators import relational as R


def missing_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN replaced by NULL; every reader here ends with it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: C.nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", comment: str | None = None, header: bool = True, timestamp_format: str | None = None) -> DataFrame:
    """CSV with an explicit schema, so the file is read once and pruned to the columns in use."""
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    return missing_to_null(reader.csv(path))


def detect_separator(spark: SparkSession, path: str, candidates: Sequence[str] = (",", ";", "\t"), comment: str = "#") -> str:
    """Separator that occurs most often in the first content line."""
    first = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith(comment)).first()
    line = first["value"] if first else ""
    return max(candidates, key=lambda c: (line.count(c), -candidates.index(c)))


def read_csv_sniffed(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """CSV of unknown separator: string columns named by the trimmed lower-case header."""
    sep = detect_separator(spark, path, comment=comment)
    df = spark.read.option("header", True).option("sep", sep).option("comment", comment).csv(path)
    return df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])


def split_fused(df: DataFrame, column: str, names: Sequence[str], sep: str = ";") -> DataFrame:
    """Break a column that holds several separated fields."""
    parts = F.split(F.col(column), f"\\Q{sep}\\E")
    return df.withColumns({n: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i, n in enumerate(names)}).drop(column)


def split_whitespace(line: str | Column, names: Sequence[str]) -> list[Column]:
    """Fields of a whitespace-separated line."""
    parts = F.split(F.trim(C.col(line)), "\\s+")
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def read_whitespace(spark: SparkSession, path: str, names: Sequence[str], skip_pattern: str | None = None) -> DataFrame:
    """Whitespace-separated text as string columns; lines that match ``skip_pattern`` are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if skip_pattern:
        lines = lines.where(~F.col("value").rlike(skip_pattern))
    return lines.select(*split_whitespace("value", names))


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns, turning what does not parse into NULL."""
    return missing_to_null(df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()}))


def alias_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the first alias found to its standard name; the rest of the columns stay."""
    renames = {R.resolve_column(df, [name, *options]): name for name, options in aliases.items()}
    missing = [n for n in aliases if n not in renames.values()]
    if None in renames:
        raise ValueError(f"no column found for one of {missing}")
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k != v})


def with_required(df: DataFrame, required: Sequence[str], default: DataFrame) -> DataFrame:
    """Match required columns without regard to case and underscores; fall back on ``default`` when one is absent."""
    plain = lambda s: s.lower().replace("_", "").strip()
    known = {plain(c): c for c in df.columns}
    if any(plain(c) not in known for c in required):
        return default.select(*required)
    return df.select(*[F.col(f"`{known[plain(c)]}`").alias(c) for c in required])
