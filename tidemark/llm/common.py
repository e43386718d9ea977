"""Shared helpers: tables, row identity, bounded Arrow batches, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Rows of one Arrow batch where whole texts go to Python, so that a batch stays small even if the texts are long.
TEXT_BATCH = "1000"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches for operators that send texts to Python; a smaller setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= int(TEXT_BATCH):
        spark.conf.set(key, TEXT_BATCH)


def text_key(text: str = "text") -> Column:
    """A 64-bit name of a text that tells rows of one id apart; a null text has a name of its own."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``_row``, so that no name of theirs can clash with those an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("_row"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: the root is the least node reachable.

    Alternates large-star and small-star steps, both a grouped minimum and a join, until the links are stars: no node
    has two roots, no root has one. Each round halves the paths, and a hub is a skewed join side that AQE splits.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = links.select(F.explode(ends).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        links = cut_lineage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        side = F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))
        nodes = links.select(F.explode(side).alias("e")).groupBy("e.n").agg(F.sum("e.up").alias("roots"), F.min("e.up").alias("least"))
        if nodes.where("roots > 1 or roots > 0 and least = 0").isEmpty():
            break
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
