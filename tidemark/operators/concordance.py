"""Concordance of two orders for series of any length: Mann-Kendall, Kendall's tau-b and the Theil-Sen slope without pairs.

Rows get dense ranks in both orders from range-sorted partitions, so ties and frequent values weigh like other rows and
every block of ranks holds exactly ``block`` rows. A pair of rows is then of one of three kinds: in one block of the
first order, in one block of the second but not of the first, or in different blocks of both. The first two are counted
block by block in memory; the third is the same question about cells of blocks with weights, which are far fewer, and
is divided again until one group holds it. Ties are put right by counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.session import cut_lineage

#: Rows of one block of ranks; blocks of one group of cells, and blocks from which cells are grouped again.
BLOCK, FAN, FEW = 65_536, 16, 256
#: Slopes of a series that are ordered in the end, and rounds of narrowing at most.
LAST, ROUNDS = 1_000_000, 60
#: Half widths, as shares of the slopes, of the intervals that a sample proposes.
SHARES = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25)
#: Rows of a checkpointed side up to which it is sent to the tasks instead of shuffling all rows to it.
SIDE = 50_000

WIDE = "decimal(38,0)"


# ------------------------------------------------------------------ in memory


def sign_total(y: np.ndarray, w: np.ndarray | None = None) -> int:
    """Sum over pairs ``i < j`` of the sign of ``y[j] - y[i]`` times both weights, by merging sorted halves."""
    y = np.asarray(y)
    w = np.ones(len(y), np.int64) if w is None else np.asarray(w, np.int64)

    def merge(lo: int, hi: int) -> tuple[int, np.ndarray]:
        if hi - lo <= 64:
            part, own = y[lo:hi], w[lo:hi]
            signs = np.tril(np.sign(part[:, None] - part[None, :]), -1).astype(np.int64)
            return int(own @ signs @ own), lo + np.argsort(part, kind="stable")
        mid = (lo + hi) // 2
        (one, left), (two, right) = merge(lo, mid), merge(mid, hi)
        upto = np.concatenate(([0], np.cumsum(w[left])))
        low, high = np.searchsorted(y[left], y[right], "left"), np.searchsorted(y[left], y[right], "right")
        cross = int((w[right] * (upto[low] + upto[high] - upto[-1])).sum())
        both = np.concatenate((left, right))
        return one + two + cross, both[np.argsort(y[both], kind="stable")]

    return merge(0, len(y))[0] if len(y) else 0


def concordant(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> int:
    """Sum over pairs of both signs times both weights; a tie in either counts nothing."""
    w = np.ones(len(x), np.int64) if w is None else np.asarray(w, np.int64)
    order = np.lexsort((y, x))
    x, y, w = np.asarray(x)[order], np.asarray(y)[order], w[order]
    total = sign_total(y, w)
    # rows of one x stand in the order of y, so each of their pairs with different y added its weights once
    per_x = np.add.reduceat(w, np.flatnonzero(np.r_[True, x[1:] != x[:-1]])) if len(x) else w
    per_xy = np.add.reduceat(w, np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else w
    return total - (int((per_x * per_x).sum()) - int((per_xy * per_xy).sum())) // 2


def inversions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``i < j`` of all pairs with ``v[i] > v[j]``; the work grows with their number, not with that of all pairs."""
    firsts, seconds = [], []

    def merge(lo: int, hi: int) -> np.ndarray:
        if hi - lo <= 64:
            i, j = np.nonzero(np.triu(v[lo:hi, None] > v[None, lo:hi], 1))
            firsts.append(lo + i)
            seconds.append(lo + j)
            return lo + np.argsort(v[lo:hi], kind="stable")
        mid = (lo + hi) // 2
        left, right = merge(lo, mid), merge(mid, hi)
        at = np.searchsorted(v[left], v[right], "right")
        count = len(left) - at
        if count.any():
            seconds.append(np.repeat(right, count))
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            firsts.append(left[np.repeat(at, count) + step])
        both = np.concatenate((left, right))
        return both[np.argsort(v[both], kind="stable")]

    if len(v) > 1:
        merge(0, len(v))
    empty = np.zeros(0, np.int64)
    return np.concatenate([*firsts, empty]).astype(np.int64), np.concatenate([*seconds, empty]).astype(np.int64)


# ------------------------------------------------------------------ in Spark


def _side(df: DataFrame) -> DataFrame:
    """A small table (of keys, or keys by partitions) for a join with all rows, which then stay where they are."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SIDE else df


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Dense positions of the rows of each key in an order: one range-sorted shuffle, counts per partition, no window over rows.

    Equal rows get positions of their own. The sorted rows are checkpointed, so a rerun keeps them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut_lineage(rows.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_c"))
    starts = starts.select(*keys, "_part", (F.coalesce(F.sum("_c").over(ahead), F.lit(0)) - F.col("_first")).alias("_off"))
    return rows.join(_side(starts), [*keys, "_part"]).withColumn(name, F.col("_seq") + F.col("_off")).drop("_part", "_seq", "_off")


def _sums(groups: DataFrame, keys: Sequence[str], by: Sequence[str], fn) -> DataFrame:
    """``keys, _s``: what ``fn`` counts in each group."""
    schema = StructType([*[groups.schema[k] for k in keys], StructField("_s", LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_s": [fn(pdf)]})

    return groups.groupBy(*keys, *by).applyInPandas(run, schema)


def _tied_pairs(rows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    c = F.count(F.lit(1)).cast(WIDE)
    per = rows.groupBy(*keys, *cols).agg((c * (c - 1)).cast(WIDE).alias("_p"))
    return per.groupBy(*keys).agg(F.sum("_p").cast(WIDE).alias("_p"))


def permutation_sum(rows: DataFrame, keys: Sequence[str], a: str, b: str, block: int = BLOCK, fan: int = FAN, few: int = FEW, longest: int | None = None) -> DataFrame:
    """``keys, s``: pairs in the same order less pairs in the other, for ranks ``a`` and ``b`` from 0, without ties; they may have gaps.

    ``longest`` is one more than the largest rank, where the caller knows it.
    """
    if longest is None:
        longest = (rows.agg(F.greatest(F.max(a), F.max(b))).first()[0] or 0) + 1
    blocks = {"_t": F.floor(F.col("_a") / block).cast("long"), "_v": F.floor(F.col("_b") / block).cast("long")}
    rows = rows.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).withColumns(blocks)
    parts = [_sums(rows.select(*keys, "_a", "_b", "_t"), keys, ["_t"], lambda p: sign_total(p.sort_values("_a")["_b"].to_numpy()))]
    if longest > block:
        many = rows.groupBy(*keys).agg(F.greatest(F.max("_a"), F.max("_b")).alias("_last")).where(F.col("_last") >= block)
        large = rows.join(many.select(*keys), list(keys))
        parts.append(_sums(large.select(*keys, "_t", "_b", "_v"), keys, ["_v"], lambda p: concordant(p["_t"].to_numpy(), p["_b"].to_numpy())))
        cells = cut_lineage(large.groupBy(*keys, "_t", "_v").agg(F.count(F.lit(1)).alias("_w")))
        count = -(-longest // block)
        both = lambda x, y: lambda p: concordant(p[x].to_numpy(), p[y].to_numpy(), p["_w"].to_numpy())
        while count > few:
            cells = cells.withColumns({"_tt": F.floor(F.col("_t") / fan), "_vv": F.floor(F.col("_v") / fan)})
            parts.append(_sums(cells, keys, ["_tt"], both("_t", "_v")))
            parts.append(_sums(cells, keys, ["_vv"], both("_tt", "_v")))
            cells = cut_lineage(cells.groupBy(*keys, F.col("_tt").alias("_t"), F.col("_vv").alias("_v")).agg(F.sum("_w").alias("_w")))
            count = -(-count // fan)
        parts.append(_sums(cells, keys, [], both("_t", "_v")))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy(*keys).agg(F.sum(F.col("_s").cast(WIDE)).cast(WIDE).alias("s"))


def concordance(df: DataFrame, keys: Sequence[str], x: str, y: str, block: int = BLOCK, fan: int = FAN, few: int = FEW, positions: bool = False) -> DataFrame:
    """``keys, n, s, tied_x, tied_y, tied_xy``: concordant less discordant pairs, and pairs with a tie in x, in y, in both.

    Rows without x or y are left out. Series of any length, with any share of the rows or of equal values. With
    ``positions`` x holds whole numbers from 0, each once in a key, and serves as its own rank.
    """
    rows = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null")
    rows = rows.withColumn("_rx", F.col("_x").cast("long")) if positions else ranked(rows, keys, ["_x", "_y"], "_rx")
    rows = cut_lineage(ranked(rows, keys, ["_y", "_rx"], "_ry"))
    out = permutation_sum(rows, keys, "_rx", "_ry", block, fan, few)
    for name, cols in (("tied_x", ["_x"]), ("tied_y", ["_y"]), ("tied_xy", ["_x", "_y"])):
        if positions and name != "tied_y":
            out = out.withColumn(name, F.lit(0).cast(WIDE))
        else:
            out = out.join(_tied_pairs(rows, keys, cols).select(*keys, (F.col("_p") / 2).cast(WIDE).alias(name)), list(keys))
    # in both rank orders a pair with any tie stands the same way, so each added one
    ties = F.col("tied_x") + F.col("tied_y") - F.col("tied_xy")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.join(out, list(keys)).select(*keys, "n", (F.col("s") - ties).cast(WIDE).alias("s"), "tied_x", "tied_y", "tied_xy")


def kendall_tau_b(df: DataFrame, keys: Sequence[str], x: str, y: str, **sizes) -> DataFrame:
    """Kendall's tau-b for series of any length: ``keys, tau_b``; null where one side never changes."""
    g = concordance(df, keys, x, y, **sizes)
    n, s, tx, ty = (F.col(c).cast("double") for c in ("n", "s", "tied_x", "tied_y"))
    pairs = n * (n - 1) / 2
    return g.select(*keys, F.try_divide(s, F.sqrt((pairs - tx) * (pairs - ty))).alias("tau_b"))


# ------------------------------------------------------------------ slopes


def _at_slope(rows: DataFrame, slopes: DataFrame, keys: Sequence[str], s: str, name: str) -> DataFrame:
    """Rows with their rank by ``y - s x``; rows of one x keep the order of y at every slope."""
    placed = rows.join(_side(slopes.select(*keys, F.col(s).alias("_s"))), list(keys)).withColumn("_r", F.col("_y") - F.col("_s") * F.col("_x"))
    return ranked(placed.drop("_s"), keys, ["_r", "_rx"], name).drop("_r")


def theil_sen_long(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "slope", block: int = BLOCK, last: int = LAST, **sizes) -> DataFrame:
    """Median pairwise slope for series of any length, pairs of equal ``x`` left out; null without a pair.

    Exact, but where more than ``last`` slopes lie so close that no interval parts them: there the value has 12 digits of
    the scale of the slopes. The pairs with a slope under ``s`` are the discordant ones of ``x`` and ``y - s x``, so one count tells on which side
    of ``s`` the median lies. The interval starts from the slopes of random pairs, one for each row, as narrow as
    their number allows, and is cut where a line through its ends' counts meets the middle rank, until few slopes are left. Those are the pairs whose order
    differs between both ends; they are listed from blocks of neighbours and ordered.
    """
    clean = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    rows = cut_lineage(ranked(clean, keys, ["_x", "_y"], "_rx"))
    copies = F.greatest(F.lit(1.0), F.count(F.lit(1)) / F.approx_count_distinct(F.xxhash64("_x", "_y")))
    n = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), copies.alias("_copies")))
    longest = n.agg(F.max("_n")).first()[0] or 0
    both = (F.col("_n").cast(WIDE) * (F.col("_n") - 1) - F.col("_p")) / 2
    pairs = cut_lineage(n.join(_tied_pairs(rows, keys, ["_x"]), list(keys)).select(*keys, "_n", "_copies", both.cast("double").alias("_pairs"), (F.col("_p") / 2).cast("double").alias("_tied")))
    state = cut_lineage(pairs.where("_pairs > 0").drop("_tied").join(_sampled(rows, n, keys), list(keys)))

    def under(slopes: DataFrame, s: str) -> DataFrame:
        """``keys, _u``: pairs with a slope under ``s``, a number that is the slope of no pair but by chance."""
        part = _at_slope(rows, slopes, keys, s, "_rr")
        same = permutation_sum(part, keys, "_rx", "_rr", block, longest=longest, **sizes)
        signed = same.join(pairs, list(keys))
        return signed.select(*keys, F.round((F.col("_pairs") - (F.col("s").cast("double") - F.col("_tied"))) / 2).alias("_u"))

    first = {"_lo": lambda d: d.withColumn("_u_lo", F.col("_u")), "_hi": lambda d: d.withColumn("_u_hi", F.col("_u"))}
    for end, put in first.items():
        state = cut_lineage(put(state.join(under(state, end), list(keys))).drop("_u"))
    state = state.withColumn("_before", F.lit(None).cast("double"))
    done, middle = [], F.floor((F.col("_pairs") - 1) / 2)
    for step in range(ROUNDS):
        missed_low, missed_high = F.col("_u_lo") > middle, F.col("_u_hi") < F.floor(F.col("_pairs") / 2) + 1
        width = F.col("_hi") - F.col("_lo")
        ready = ~missed_low & ~missed_high & ((F.col("_u_hi") - F.col("_u_lo") <= last) | (width <= 1e-11 * F.col("_scale")))
        state = state.withColumn("_ready", ready)
        done.append(state.where("_ready").drop("_ready"))
        state = cut_lineage(state.where("not _ready").drop("_ready"))
        if state.isEmpty():
            break
        # aim past the middle rank, seen from its nearer end, by three times what even counts stray, rows that come again making
        # pairs that do; halve where the last cut left most
        left = F.col("_u_hi") - F.col("_u_lo")
        share = F.least(F.greatest(F.try_divide(F.col("_pairs") / 2 - F.col("_u_lo"), left), F.lit(0.0)), F.lit(1.0))
        apart = left / F.pow("_copies", F.lit(2))
        lean = F.least(3 * F.sqrt(F.try_divide(share * (1 - share) + F.try_divide(F.lit(1.0), apart), apart)) + 1e-6 * (1 + F.rand(step)), F.lit(0.25))
        guess = F.col("_lo") + width * F.least(F.greatest(F.when(share > 0.5, share - lean).otherwise(share + lean), F.lit(0.001)), F.lit(0.999))
        guess = F.when(left > 0.75 * F.col("_before"), F.col("_lo") + width * (0.45 + 0.1 * F.rand(step))).otherwise(guess)
        if step in (2, 3):  # still inside after two cuts, so many equal slopes: is the median that of the sample?
            near = F.col("_c") + (1e-12 if step == 3 else -1e-12) * F.col("_scale")
            guess = F.when((near > F.col("_lo")) & (near < F.col("_hi")), near).otherwise(guess)
        guess = F.when(missed_low, F.col("_lo") - width * (2 + F.rand(step))).when(missed_high, F.col("_hi") + width * (2 + F.rand(step))).otherwise(guess)
        tried = cut_lineage(state.withColumn("_try", guess))
        tried = tried.join(under(tried, "_try"), list(keys))
        low = F.col("_u") <= middle
        moved = {
            "_hi": F.when(low, F.when(missed_high, F.col("_try")).otherwise(F.col("_hi"))).otherwise(F.col("_try")),
            "_u_hi": F.when(low, F.when(missed_high, F.col("_u")).otherwise(F.col("_u_hi"))).otherwise(F.col("_u")),
            "_lo": F.when(low, F.when(missed_high, F.col("_lo")).otherwise(F.col("_try"))).otherwise(F.when(missed_low, F.col("_try")).otherwise(F.col("_lo"))),
            "_u_lo": F.when(low, F.when(missed_high, F.col("_u_lo")).otherwise(F.col("_u"))).otherwise(F.when(missed_low, F.col("_u")).otherwise(F.col("_u_lo"))),
        }
        # a missed end moves and takes the count with it; the other end stays where it is
        state = cut_lineage(tried.select(*keys, "_n", "_copies", "_pairs", "_c", "_scale", (F.col("_u_hi") - F.col("_u_lo")).alias("_before"), *[v.alias(k) for k, v in moved.items()]))
    found = state
    for d in done:
        found = found.unionByName(d)
    found = cut_lineage(found)
    # slopes that no interval can part are one number
    one = F.when(F.col("_c").between(F.col("_lo"), F.col("_hi")), F.col("_c")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
    whole = found.where(F.col("_u_hi") - F.col("_u_lo") > last).select(*keys, one.alias(name))
    few = found.where(F.col("_u_hi") - F.col("_u_lo") <= last)
    listed = _between(rows, few, keys, block)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_slope")) - 1 + F.col("_u_lo")
    middles = listed.join(few, list(keys)).withColumn("_place", place).where((F.col("_place") >= middle) & (F.col("_place") <= F.floor(F.col("_pairs") / 2)))
    out = middles.groupBy(*keys).agg(F.avg("_slope").alias(name)).unionByName(whole)
    return n.select(*keys).join(out, list(keys), "left")


def _sampled(rows: DataFrame, n: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _lo, _hi, _c, _scale``: an interval around ``_c``, the median slope of one random pair for each row, and the size of slopes."""
    pairs = rows.join(n, list(keys)).withColumn("_other", F.pmod(F.xxhash64("_rx", F.lit(11)), F.col("_n")))
    others = rows.select(*keys, F.col("_rx").alias("_other"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    slope = F.try_divide(F.col("_y2") - F.col("_y"), F.col("_x2") - F.col("_x"))
    met = pairs.join(others, [*keys, "_other"]).select(*keys, slope.alias("_s")).where("_s is not null")
    points = [0.25, 0.5, 0.75, *[0.5 + side * share for share in SHARES for side in (-1, 1)]]
    ends = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.percentile_approx("_s", F.array(*[F.lit(p) for p in points]), 50_000).alias("_q"))
    scale = F.greatest(F.col("_q")[2] - F.col("_q")[0], F.abs(F.col("_q")[1]), F.lit(1e-300))
    # five deviations of the sample's median, and the error of the quantiles themselves
    enough = 2.5 / F.sqrt("_m") + 4e-5
    at = F.coalesce(*[F.when(enough <= share, F.lit(3 + 2 * k)) for k, share in enumerate(SHARES)], F.lit(1 + 2 * len(SHARES)))
    pad = F.when(F.col("_m") >= 100, 1e-9 * scale).otherwise(scale) + 1e-16
    lo, hi = F.element_at("_q", at + 1) - pad, F.element_at("_q", at + 2) + pad
    sampled = ends.select(*keys, lo.alias("_lo"), hi.alias("_hi"), F.col("_q")[1].alias("_c"), scale.alias("_scale"))
    # a series of few rows may have drawn only pairs of equal x
    missing = n.join(sampled, list(keys), "left_anti").select(*keys, F.lit(-1.0319).alias("_lo"), F.lit(1.0173).alias("_hi"), F.lit(0.0).alias("_c"), F.lit(1.0).alias("_scale"))
    return sampled.unionByName(missing)


def _between(rows: DataFrame, state: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """``keys, _slope`` of the pairs with a slope between ``_lo`` and ``_hi``: those that stand differently at both ends.

    With ``far`` the largest change of a rank, a pair lies within ``2 far`` ranks, so blocks that wide and their next
    neighbour hold every pair. Groups are bounded by the number of slopes that are left.
    """
    both = cut_lineage(_at_slope(_at_slope(rows.join(state.select(*keys), list(keys), "left_semi"), state, keys, "_lo", "_ra"), state, keys, "_hi", "_rb"))
    far = both.groupBy(*keys).agg(F.max(F.abs(F.col("_ra") - F.col("_rb"))).alias("_far"))
    wide = F.greatest(2 * F.col("_far"), F.lit(block))
    spread = both.join(far, list(keys)).withColumn("_g", F.floor(F.col("_ra") / wide).cast("long"))
    spread = spread.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_g", F.col("_g") - F.col("_copy")).where("_g >= 0")
    schema = StructType([*[rows.schema[k] for k in keys], StructField("_slope", DoubleType())])

    def listed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ra")
        i, j = inversions(pdf["_rb"].to_numpy())
        own = pdf["_copy"].to_numpy()[i] == 0
        i, j = i[own], j[own]
        xs, ys = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
        slope = (ys[j] - ys[i]) / (xs[j] - xs[i])
        return pd.DataFrame({**{k: np.repeat(pdf[k].to_numpy()[:1], len(slope)) for k in keys}, "_slope": slope})

    return spread.groupBy(*keys, "_g").applyInPandas(listed, schema)
