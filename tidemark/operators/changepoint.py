"""Change points: split scores, window splits, kernel segmentation, votes and segmented fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.functions import columns as C
from tidemark.operators import blocked as B
from tidemark.operators import regress as G
from tidemark.operators import series as S


def split_scores(df: DataFrame, keys: Sequence[str], idx: str, value: str, trim: int = 10, block: int | None = None) -> DataFrame:
    """Score of splitting before each position: squared mean difference over pooled variance.

    Both sides follow from running sums of the centred series and its square.  With
    ``block`` the running sums go block by block, for series of any length.
    """
    rows = df.select(*keys, idx, value)
    series = Window.partitionBy(*keys)
    if block:
        rows = rows.withColumn("_b", F.floor(F.col(idx) / block))
        g = rows.groupBy(*keys, "_b").agg(F.count(value).alias("_bn"), F.avg(value).alias("_bm"), F.var_pop(value).alias("_bv"))
        n = F.sum("_bn").over(series)
        g = g.withColumns({"_n": n, "_mean": F.sum(F.col("_bn") * F.col("_bm")).over(series) / n})
        off = F.col("_bm") - F.col("_mean")
        g = g.withColumns({"_bs": F.col("_bn") * off, "_bq": F.col("_bn") * (F.col("_bv") + off * off)})
        before = series.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumns({"_s0": F.coalesce(F.sum("_bs").over(before), F.lit(0.0)), "_q0": F.coalesce(F.sum("_bq").over(before), F.lit(0.0)), "_ss": F.sum("_bq").over(series)})
        rows = rows.join(g.select(*keys, "_b", "_n", "_mean", "_s0", "_q0", "_ss"), [*keys, "_b"])
        inside = Window.partitionBy(*keys, "_b")
    else:
        rows = rows.withColumns({"_n": F.count(value).over(series), "_mean": F.avg(value).over(series), "_ss": F.var_pop(value).over(series) * F.count(value).over(series), "_s0": F.lit(0.0), "_q0": F.lit(0.0)})
        inside = series
    upto = inside.orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_d", F.col(value) - F.col("_mean")).withColumn("_dd", F.col("_d") * F.col("_d"))
    rows = rows.withColumns({"_s": F.col("_s0") + F.sum("_d").over(upto), "_q": F.col("_q0") + F.sum("_dd").over(upto)})
    n1 = F.col(idx).cast("double")
    n2 = F.col("_n") - n1
    s1, q1 = F.col("_s") - F.col("_d"), F.col("_q") - F.col("_dd")
    m1, m2 = s1 / n1, -s1 / n2
    v1, v2 = q1 / n1 - m1 * m1, (F.col("_ss") - q1) / n2 - m2 * m2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (F.col("_n") - 2)
    kept = (F.col(idx) >= trim) & (F.col(idx) < F.col("_n") - trim)
    score = F.when(pooled > 0, (m1 - m2) * (m1 - m2) / pooled)
    return rows.where(kept).select(*keys, idx, score.alias("score")).where(F.col("score").isNotNull())


def window_scores(df: DataFrame, keys: Sequence[str], idx: str, value: str, window: int = 24, block: int | None = None) -> DataFrame:
    """Absolute difference between the means of the ``window`` rows from and before each position."""
    score = lambda w: F.abs(F.avg(value).over(w.rowsBetween(0, window - 1)) - F.avg(value).over(w.rowsBetween(-window, -1)))
    ahead = lambda w: F.count(F.lit(1)).over(w.rowsBetween(1, window))
    rows = df.select(*keys, idx, value)
    if block:
        rows = B.windowed(rows, keys, idx, window, window, {"score": score, "_ahead": ahead}, block)
    else:
        rows = rows.withColumns({"score": score(S.by(keys, idx)), "_ahead": ahead(S.by(keys, idx))})
    return rows.where((F.col(idx) >= window) & (F.col("_ahead") == window)).select(*keys, idx, "score")


def best_split(scores: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Position of the highest score, the earliest on ties: ``keys, change_index, score``."""
    best = F.min(F.struct((-F.col("score")).alias("k"), F.col(idx).alias("i")))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.i").alias("change_index"), (-F.col("_b.k")).alias("score"))


def kernel_segments(x: np.ndarray, penalty: float, min_size: int = 2, jump: int = 5) -> list[int]:
    """Optimal breakpoints of a series under an RBF kernel cost with a penalty per break (pruned search)."""
    n = len(x)
    sq = (x[:, None] - x[None, :]) ** 2
    off = sq[np.triu_indices(n, 1)]
    gamma = 1.0 / np.median(off) if len(off) and np.median(off) > 0 else 1.0
    gram = np.exp(-np.clip(sq * gamma, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = gram.cumsum(0).cumsum(1)
    diag = np.concatenate([[0.0], np.diag(gram).cumsum()])

    def cost(a: int, b: int) -> float:
        inner = total[b, b] - total[a, b] - total[b, a] + total[a, a]
        return diag[b] - diag[a] - inner / (b - a)

    ends = [e for e in range(jump, n, jump) if e >= min_size] + [n]
    best, live = {0: (0.0, 0)}, [0]
    for end in ends:
        trial = [(best[s][0] + cost(s, end) + penalty, s) for s in live if end - s >= min_size]
        if not trial:
            continue
        best[end] = min(trial)
        live = [s for c, s in trial if c <= best[end][0] + penalty] + [s for s in live if end - s < min_size] + [end]
    cuts, at = [], n
    while at > 0 and at in best:
        cuts.append(at)
        at = best[at][1]
    return sorted(cuts)


def pelt(df: DataFrame, keys: Sequence[str], order: str, value: str, penalty: float = 5.0) -> DataFrame:
    """Kernel segmentation of calendar series: ``keys, breakpoints`` (ends, the series end last)."""
    schema = StructType([*[f for f in df.schema.fields if f.name in keys], StructField("breakpoints", ArrayType(LongType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "breakpoints": [kernel_segments(x, penalty)]})

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def vote(detections: Sequence[DataFrame], lengths: DataFrame, keys: Sequence[str], fallback: int = 60) -> DataFrame:
    """Whole part of the median of the detected positions; ``n - fallback`` where nothing was detected."""
    votes = detections[0].select(*keys, "change_index")
    for d in detections[1:]:
        votes = votes.unionByName(d.select(*keys, "change_index"))
    mid = votes.groupBy(*keys).agg(F.floor(F.median("change_index")).cast("long").alias("_m"))
    return lengths.join(mid, list(keys), "left").select(*keys, F.coalesce("_m", F.col("n") - fallback).alias("change_index"))


def season_features(idx: str, total: Column) -> dict[str, Column]:
    sin, cos = C.seasonal_pair("month")
    return {"tn": F.col(idx) / total, "sin": sin, "cos": cos}


FEATURES = ["tn", "sin", "cos"]


def segmented_fit(df: DataFrame, keys: Sequence[str], idx: str, value: str, change: DataFrame) -> DataFrame:
    """Trend-and-season fits before and after each series' change point: ``keys, segment, n, coef, intercept, r2``."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(total, list(keys)).join(change.select(*keys, "change_index"), list(keys))
    rows = rows.withColumns(season_features(idx, F.col("_n")))
    rows = rows.withColumn("segment", F.when(F.col(idx) < F.col("change_index"), "pre").otherwise("post"))
    return G.fit(rows, [*keys, "segment"], FEATURES, value)
