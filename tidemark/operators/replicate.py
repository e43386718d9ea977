"""Bootstrap by multiplicities: how often each row is drawn in each replicate, and weighted sums of all replicates at once.

A replicate draws as many rows as the series has, with replacement. Positions fall into blocks; a block's share of the
draws follows from binomial splits down a binary tree of blocks, and inside the block every draw picks one of its rows,
so the multiplicities are multinomial over the whole series. Splits and picks come from seeds that name the node or
the draw: a task that is run again draws the same. Rows pass once, in blocks of bounded size; no draw is a row, and
nothing is joined on draws.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.functions import kernels
from tidemark.operators import inference as I
from tidemark.operators import regress as G
from tidemark.operators import series as S
from tidemark.operators.resample import block_length

#: Positions of one block, and replicates whose multiplicities are held at once.
BLOCK, AT_ONCE = 4096, 100
#: Rows whose predictions by all replicates are held at once.
BAND_ROWS = 512

#: Picks below ``n`` for replicates and places (arrays that broadcast).
Draw = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def hash_draw(seed: int) -> Draw:
    """Picks from the mixed bits of seed, replicate and place."""

    def draw(rep, place, n):
        z = (rep.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) % np.asarray(n).astype(np.uint64)).astype(np.int64)

    return draw


def block_draws(n: int, draws: np.ndarray, block: int, at: int, seed: int) -> np.ndarray:
    """How many of each replicate's ``draws`` from ``n`` positions fall into block ``at``: one binomial split at each tree node."""
    lo, hi, left_over = 0, -(-n // block), draws
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = (mid - lo) * block / (min(n, hi * block) - lo * block)
        left = np.random.default_rng([seed, lo, hi]).binomial(left_over, share)
        lo, hi, left_over = (lo, mid, left) if at < mid else (mid, hi, left_over - left)
    return left_over


def multiplicities(n: int, reps: np.ndarray, draws: np.ndarray, at: int, draw: Draw, seed: int = 0, block: int = BLOCK) -> np.ndarray:
    """Replicates by rows of block ``at``: how often each row is drawn; ``draws`` of all replicates are given, ``reps`` chosen."""
    size = min(block, n - at * block)
    share = block_draws(n, draws, block, at, seed)[reps]
    out = np.zeros((len(reps), size))
    places = np.arange(int(share.max(initial=0)))
    for k, (rep, count) in enumerate(zip(reps, share)):
        picks = draw(np.full(count, rep, np.int64), at * block + places[:count], np.full(count, size, np.int64))
        out[k] = np.bincount(picks, minlength=size)
    return out


def _fields(df: DataFrame, names: Sequence[str]) -> list[StructField]:
    return [df.schema[name] for name in names]


def moments(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], reps: int, draw: Draw, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``keys, rep, n, means, covs`` of every replicate, as :func:`regress.moments` gives them of the rows themselves.

    ``idx`` counts the rows of a key from 0 without gaps, and no value is missing. Values are taken about the mean of
    their key, so the sums keep their digits. A block yields one row of sums for each replicate, added up per key.
    """
    rows = df.select(*keys, idx, *[F.col(c).cast("double").alias(c) for c in cols])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in cols]).alias("_centre"))
    rows = rows.join(sizes, list(keys)).withColumn("_b", F.floor(F.col(idx) / block).cast("long"))
    upper = np.triu_indices(len(cols))
    names = [*keys, "_rep", "_s"]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        n, at = int(pdf["_n"].iloc[0]), int(pdf["_b"].iloc[0])
        z = pdf[list(cols)].to_numpy(float) - np.asarray(pdf["_centre"].iloc[0], float)
        products = np.hstack([z, z[:, upper[0]] * z[:, upper[1]]])
        draws, parts = np.full(reps, n), []
        for first in range(0, reps, AT_ONCE):
            chosen = np.arange(first, min(reps, first + AT_ONCE))
            parts.append(multiplicities(n, chosen, draws, at, draw, seed, block) @ products)
        out = {k: [pdf[k].iloc[0]] * reps for k in keys}
        return pd.DataFrame({**out, "_rep": np.arange(reps), "_s": list(np.vstack(parts))}, columns=names)

    schema = StructType([*_fields(rows, keys), StructField("_rep", LongType()), StructField("_s", ArrayType(DoubleType()))])
    cells = rows.groupBy(*keys, "_b").applyInPandas(sums, schema)
    width = len(cols) + len(upper[0])
    whole = cells.groupBy(*keys, "_rep").agg(F.array(*[F.sum(F.col("_s")[i]) for i in range(width)]).alias("_s")).join(sizes, list(keys))
    shift = [F.col("_s")[i] / F.col("_n") for i in range(len(cols))]
    covs = [F.col("_s")[len(cols) + k] / F.col("_n") - shift[i] * shift[j] for k, (i, j) in enumerate(zip(*upper))]
    means = [F.col("_centre")[i] + shift[i] for i in range(len(cols))]
    return whole.select(*keys, F.col("_rep").alias("rep"), F.col("_n").alias("n"), F.array(*means).alias("means"), F.array(*covs).alias("covs"))


def models(df: DataFrame, keys: Sequence[str], idx: str, xs: Sequence[str], y: str, reps: int, draw: Draw, seed: int = 0) -> DataFrame:
    """The least-squares model of every replicate: ``keys, rep, coef, intercept``; without enough rows there is none."""
    m = moments(df, keys, idx, [*xs, y], reps, draw, seed).withColumn("_m", G.solver(len(xs))("n", "means", "covs"))
    return m.select(*keys, "rep", "_m.coef", "_m.intercept").where("coef is not null")


def coefficient_intervals(df: DataFrame, keys: Sequence[str], idx: str, xs: Sequence[str], y: str, reps: int, draw: Draw, levels: Sequence[int] = (90, 95, 99), seed: int = 0) -> DataFrame:
    """Percentile intervals of regression coefficients: ``keys, name, level, ci_lower, ci_upper``."""
    fitted = models(df, keys, idx, xs, y, reps, draw, seed).select(*keys, F.posexplode("coef").alias("_i", "_c"))
    cut = [F.percentile("_c", (100 + side * lv) / 200).alias(f"_{'hi' if side > 0 else 'lo'}{lv}") for lv in levels for side in (-1, 1)]
    rows = F.array(*[F.struct(F.lit(lv).cast("long").alias("level"), F.col(f"_lo{lv}").alias("ci_lower"), F.col(f"_hi{lv}").alias("ci_upper")) for lv in levels])
    name = F.array(*[F.lit(x) for x in xs])[F.col("_i")].alias("name")
    return fitted.groupBy(*keys, "_i").agg(*cut).select(*keys, name, F.inline(rows))


def trend_band(df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, horizon: int, reps: int, draw: Draw, seed: int = 0) -> DataFrame:
    """Forecast band of a straight line from all replicates: ``keys, x, ci_lower, ci_upper``; replicates of a single ``x`` drop out."""
    m = moments(df, keys, idx, [x, y], reps, draw, seed).where(F.col("covs")[0] > 1e-9)
    slope = F.col("covs")[1] / F.col("covs")[0]
    last = df.groupBy(*keys).agg(F.max(x).alias("_last"))
    ahead = m.join(last, list(keys)).withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(x, (F.col("_last") + F.col("_h")).cast("long"))
    ahead = ahead.withColumn("_v", F.col("means")[1] + slope * (F.col(x) - F.col("means")[0]))
    return ahead.groupBy(*keys, x).agg(F.percentile("_v", 0.025).alias("ci_lower"), F.percentile("_v", 0.975).alias("ci_upper"))


def prediction_bands(df: DataFrame, keys: Sequence[str], idx: str, xs: Sequence[str], y: str, reps: int, draw: Draw, levels: Sequence[int] = (90, 95, 99), seed: int = 0) -> DataFrame:
    """Bands of the fitted values of a regression: ``keys, idx, level, ci_lower, ci_upper`` for every row and level.

    The replicates' models of a key (their number is a parameter) travel once for each block of rows, and a block's
    predictions by all of them are one matrix product; no row is repeated for a replicate.
    """
    fitted = models(df, keys, idx, xs, y, reps, draw, seed).groupBy(*keys).agg(F.collect_list(F.concat(F.array("intercept"), "coef")).alias("_models"))
    inputs = F.struct(F.col(idx).alias("i"), F.array(*[F.col(x).cast("double") for x in xs]).alias("x"))
    blocks = df.groupBy(*keys, F.floor(F.col(idx) / BAND_ROWS).alias("_b")).agg(F.collect_list(inputs).alias("_rows")).join(fitted, list(keys))
    schema = StructType([*_fields(df, [*keys, idx]), StructField("level", LongType()), StructField("ci_lower", DoubleType()), StructField("ci_upper", DoubleType())])
    cut = [(100 + side * lv) / 2 for lv in levels for side in (-1, 1)]

    def bands(batches):
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                rows, beta = row[-2], np.stack(row[-1])
                x = np.stack([r["x"] for r in rows])
                ends = np.percentile(beta[:, :1].T + x @ beta[:, 1:].T, cut, axis=1)
                at = [r["i"] for r in rows]
                for k, lv in enumerate(levels):
                    yield pd.DataFrame({**{key: [row[j]] * len(at) for j, key in enumerate(keys)}, idx: at, "level": lv, "ci_lower": ends[2 * k], "ci_upper": ends[2 * k + 1]})

    return blocks.select(*keys, "_rows", "_models").mapInPandas(bands, schema)


def sen_interval(df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, reps: int, draw: Draw, seed: int = 0) -> DataFrame:
    """Mean, sd and 95 % interval of the Theil-Sen slope over replicates; those of a single ``x`` drop out.

    A rank statistic has no sums: a calendar series is one task and its replicates are drawn there.
    """
    rows = df.select(*keys, idx, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))

    def slopes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        n, found = len(pdf), []
        xs, ys = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
        for first in range(0, reps, AT_ONCE):
            chosen = np.arange(first, min(reps, first + AT_ONCE))
            blocks = range(-(-n // BLOCK))
            counts = np.hstack([multiplicities(n, chosen, np.full(reps, n), at, draw, seed) for at in blocks])
            for w in counts.astype(int):
                found.append(kernels.theil_sen(np.repeat(xs, w), np.repeat(ys, w)))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(found) for k in keys}, "slope": found})

    schema = StructType([*_fields(rows, keys), StructField("slope", DoubleType())])
    drawn = rows.groupBy(*keys).applyInPandas(slopes, schema).where("slope is not null and not isnan(slope)")
    return drawn.groupBy(*keys).agg(
        F.avg("slope").alias("mean"), F.stddev_pop("slope").alias("std"), F.percentile("slope", 0.025).alias("ci_lower"), F.percentile("slope", 0.975).alias("ci_upper")
    )


def covers(n: int, length: int, reps: np.ndarray, every: int, at: int, draw: Draw, seed: int = 0, block: int = BLOCK) -> np.ndarray:
    """Replicates by rows of block ``at``: how many moving blocks of ``length`` rows cover each row.

    A replicate strings ``ceil(n / length)`` blocks together, and the last counts only as far as ``n`` rows. Starts are
    drawn like rows; a block of positions is covered by starts in it and in the one before, as ``length <= block``.
    """
    starts, whole = n - length + 1, -(-n // length) - 1
    low, high = at * block, min(n, (at + 1) * block)
    first = max(0, low - block)  # of the block before
    steps = np.zeros((len(reps), high - first + length + 1))
    draws = np.full(every, whole)
    for near in (at - 1, at):
        if 0 <= near * block < starts:
            count = multiplicities(starts, reps, draws, near, draw, seed, block)
            from_ = near * block - first
            steps[:, from_ : from_ + count.shape[1]] += count
            steps[:, from_ + length : from_ + length + count.shape[1]] -= count
    last = draw(reps.astype(np.int64), np.full(len(reps), whole, np.int64), np.full(len(reps), starts, np.int64))
    for edge, sign in ((last, 1.0), (last + n - length * whole, -1.0)):
        steps[np.arange(len(reps)), np.clip(edge - first, 0, steps.shape[1] - 1)] += sign
    return np.cumsum(steps, axis=1)[:, low - first : high - first]


def block_welch_pairs(df: DataFrame, keys: Sequence[str], group: str, groups: Sequence[str], order: str, value: str, reps: int, draw: Draw, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Moving-block bootstrap of Welch's t between every two groups: ``keys, one, two, t_stat, p, ci_lower, ci_upper``.

    ``groups`` lists the groups in order, and ``one`` stands before ``two``. A pair takes the longer of its two block
    lengths; a group is resampled once for each length that its pairs take. Weighted sums of a group's rows, block by
    block, give the moments of every replicate. Replicates without spread have no t and drop out.
    """
    rows = S.with_index(df.where(F.col(group).isin(*groups)).select(*keys, group, order, F.col(value).cast("double").alias("_v")), [*keys, group], order, "_i")
    sizes = block_length(rows, [*keys, group], "_i", "_v")
    side = lambda name, k: sizes.select(*keys, F.col(group).alias(name), F.col("n").alias(f"_n{k}"), F.col("block").alias(f"_k{k}"))
    place = lambda c: F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(c))
    pairs = side("one", 0).join(side("two", 1), list(keys)).where(place("one") < place("two"))
    longest = F.greatest("_k0", "_k1")
    pairs = pairs.select(*keys, "one", "two", "_n0", "_n1", F.least(longest, "_n0").alias("_l0"), F.least(longest, "_n1").alias("_l1"))
    plan = [pairs.select(*keys, F.col(c).alias(group), F.col(f"_n{k}").alias("_n"), F.col(f"_l{k}").alias("_len")) for k, c in enumerate(("one", "two"))]
    plan = plan[0].unionByName(plan[1]).distinct()
    centre = rows.groupBy(*keys, group).agg(F.avg("_v").alias("_centre"))
    plan = plan.join(centre, [*keys, group])
    rows = rows.join(plan, [*keys, group]).withColumn("_b", F.floor(F.col("_i") / block).cast("long"))
    unit = [*keys, group, "_len"]
    schema = StructType([*_fields(rows, unit), StructField("rep", LongType()), StructField("_s1", DoubleType()), StructField("_s2", DoubleType())])

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        n, length, at = (int(pdf[c].iloc[0]) for c in ("_n", "_len", "_b"))
        z = pdf["_v"].to_numpy() - pdf["_centre"].iloc[0]
        sums = [covers(n, length, np.arange(f, min(reps, f + AT_ONCE)), reps, at, draw, seed, block) @ np.column_stack([z, z * z]) for f in range(0, reps, AT_ONCE)]
        head = {k: [pdf[k].iloc[0]] * reps for k in unit}
        return pd.DataFrame({**head, "rep": np.arange(reps), "_s1": np.vstack(sums)[:, 0], "_s2": np.vstack(sums)[:, 1]})

    m = rows.groupBy(*unit, "_b").applyInPandas(drawn, schema).groupBy(*unit, "rep").agg(F.sum("_s1").alias("_s1"), F.sum("_s2").alias("_s2"))
    m = m.join(plan, unit)
    n, shift = F.col("_n"), F.col("_s1") / F.col("_n")
    var = (F.col("_s2") - n * shift * shift) / F.when(n > 1, n - 1)
    m = m.select(*unit, "rep", (F.col("_centre") + shift).alias("_mean"), (F.when(var > 0, var).otherwise(var * 0) / n).alias("_se"))
    met = pairs.drop("_n0", "_n1")
    for k, c in enumerate(("one", "two")):
        own = m.select(*keys, F.col(group).alias(c), F.col("_len").alias(f"_l{k}"), "rep", F.col("_mean").alias(f"_m{k}"), F.col("_se").alias(f"_s{k}"))
        met = met.join(own, [*keys, c, f"_l{k}", *(["rep"] if k else [])])
    t = met.select(*keys, "one", "two", F.try_divide(F.col("_m0") - F.col("_m1"), F.sqrt(F.col("_s0") + F.col("_s1"))).alias("t_stat")).where("t_stat is not null")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return t.groupBy(*keys, "one", "two").agg(
        F.avg("t_stat").alias("t_stat"),
        (2 * F.least(share(F.col("t_stat") <= 0), share(F.col("t_stat") >= 0))).alias("p"),
        F.percentile("t_stat", 0.025).alias("ci_lower"),
        F.percentile("t_stat", 0.975).alias("ci_upper"),
    )


def block_welch(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, order: str, value: str, reps: int, draw: Draw, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """:func:`block_welch_pairs` of two groups: ``keys, t_stat, p, ci_lower, ci_upper``."""
    return block_welch_pairs(df, keys, group, (a, b), order, value, reps, draw, seed, block).drop("one", "two")
