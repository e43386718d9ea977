"""Sinks: CSV in its variants, one table per sheet, text and LaTeX reports, resumable result stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C

BYTE_ORDER_MARK = "﻿"


def write_csv(df: DataFrame, path: str, sep: str = ",", bom: bool = False, index: Sequence[str] = (), single_file: bool = False) -> None:
    """CSV with a header; ``index`` columns come first, ``bom`` marks each file as UTF-8.

    ``single_file`` is for result tables of bounded size.
    """
    ordered = df.select(*index, *[F.col(f"`{c}`") for c in df.columns if c not in index]) if index else df
    if bom:
        first = ordered.columns[0]
        ordered = ordered.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_sheets(sheets: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One table per sheet below a folder."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/{name}")


# ------------------------------------------------------------------ resumable stores


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored results, or an empty table before the first run."""
    from tidemark.sources.formats import exists

    return spark.read.schema(schema).parquet(path) if exists(path) else spark.createDataFrame([], schema)


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``, so a repeated run leaves no duplicates."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


# ------------------------------------------------------------------ reports

# Latin and Persian digits, in order.
LATIN_DIGITS, PERSIAN_DIGITS = "0123456789", "۰۱۲۳۴۵۶۷۸۹"


def report_number(c: C.ColumnLike, digits: int = 4, missing: str = "--") -> Column:
    """Number as report text: scientific above a million, fixed decimals below, dashes when missing."""
    v = C.col(c).cast("double")
    text = F.when(F.abs(v) > 1e6, F.format_string("%.2e", v)).otherwise(F.format_string(f"%.{digits}f", v))
    return F.when(v.isNull() | F.isnan(v), F.lit(missing)).otherwise(text)


def persian_digits(c: C.ColumnLike) -> Column:
    return F.translate(C.col(c), LATIN_DIGITS, PERSIAN_DIGITS)


def latex_text(c: C.ColumnLike) -> Column:
    """Escape the characters LaTeX reserves in running text."""
    return F.regexp_replace(C.col(c).cast("string"), r"([&%$#_{}])", r"\\$1")


def latex_rows(df: DataFrame, labels: Sequence[str], numbers: Sequence[str], digits: int = 4) -> DataFrame:
    """One LaTeX table row per record, as ``labels, line``."""
    cells = [latex_text(c) for c in labels] + [report_number(c, digits) for c in numbers]
    return df.select(*labels, F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def latex_table(df: DataFrame, labels: Sequence[str], numbers: Sequence[str], caption: str, order: Sequence[str], most: int = 100_000) -> str:
    """A long table over result rows; refuses more than ``most`` rows, which no report holds."""
    rows = latex_rows(df, labels, numbers).orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = " & ".join([*labels, *numbers]).replace("_", "\\_") + " \\\\"
    spec = "l" * len(labels) + "r" * len(numbers)
    body = [f"\\begin{{longtable}}{{{spec}}}", f"\\caption{{{caption}}} \\\\", "\\hline", head, "\\hline", "\\endhead", *[r["line"] for r in rows], "\\hline", "\\end{longtable}"]
    return "\n".join(body)


def significance_rows(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Mark report rows by significance, as the colour of their table row."""
    return df.withColumn("row_colour", F.when(C.significant(p, alpha), "green").when(F.col(p).isNull(), "grey").otherwise("white"))


def write_text(lines: DataFrame, path: str, column: str = "line") -> None:
    """Report lines as text, in the frame's order."""
    lines.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def parameter_key(params: Mapping) -> Column:
    """Cache key of a parameter set: the same parameters give the same key."""
    return F.md5(F.lit(repr(sorted(params.items()))))


def newest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Latest version of each key."""
    best = F.max(F.struct(order, *[c for c in df.columns if c not in (*keys, order)])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*")


