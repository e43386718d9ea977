"""Spectra, coherence, wavelets and seasonal decomposition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import kernels
from tidemark.operators import series as S


def _schema(df: DataFrame, keys: Sequence[str], **fields) -> StructType:
    return StructType([*[f for f in df.schema.fields if f.name in keys], *[StructField(n, t) for n, t in fields.items()]])


def _keyed(pdf: pd.DataFrame, keys: Sequence[str], data: dict) -> pd.DataFrame:
    out = pd.DataFrame(data)
    for k in reversed(list(keys)):
        out.insert(0, k, pdf[k].iloc[0])
    return out


def power_spectrum(df: DataFrame, keys: Sequence[str], order: str, value: str, per_year: float = 12.0) -> DataFrame:
    """Power of the discrete Fourier transform of calendar series: ``keys, k, frequency, power``.

    Frequencies are cycles per year when a year has ``per_year`` rows.
    """
    rows = df.select(*keys, order, value).where(F.col(value).isNotNull())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        p = np.abs(np.fft.rfft(y)) ** 2
        return _keyed(pdf, keys, {"k": np.arange(len(p)), "frequency": np.fft.rfftfreq(len(y), 1 / per_year), "power": p})

    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, k=LongType(), frequency=DoubleType(), power=DoubleType()))


def peaks(spectrum: DataFrame, keys: Sequence[str], height: float = 0.9) -> DataFrame:
    """Interior maxima at or above a quantile of the power: ``keys, k, frequency, period, power``.

    Equal neighbours form one flat top, which counts if the power falls on both sides; its middle row stands for it.
    """
    w = S.by(keys, "k")
    floor = spectrum.groupBy(*keys).agg(F.percentile("power", height).alias("_h"))
    rows = spectrum.withColumns({"_at": F.row_number().over(w), "_a": F.lag("power").over(w), "_b": F.lead("power").over(w)})
    starts, ends = ~F.col("_a").eqNullSafe(F.col("power")), ~F.col("_b").eqNullSafe(F.col("power"))
    rows = rows.withColumn("_flat", F.sum(starts.cast("int")).over(w))
    flat = Window.partitionBy(*keys, "_flat")
    middle = F.floor((F.min("_at").over(flat) + F.max("_at").over(flat)) / 2)
    sides = {"_mid": middle, "_a": F.max(F.when(starts, F.col("_a"))).over(flat), "_b": F.max(F.when(ends, F.col("_b"))).over(flat)}
    rows = rows.withColumns(sides).join(floor, list(keys))
    higher = (F.col("power") > F.col("_a")) & (F.col("power") > F.col("_b")) & (F.col("power") >= F.col("_h"))
    top = rows.where(higher & (F.col("_at") == F.col("_mid")))
    return top.select(*keys, "k", "frequency", F.try_divide(F.lit(1.0), F.col("frequency")).alias("period"), "power")


def dominant_periods(found: DataFrame, keys: Sequence[str], at_least: float = 0.0, first: int = 5) -> DataFrame:
    """The first periods of each key's peaks that exceed a length, in order of frequency."""
    rows = S.with_index(found.where(F.col("period") > at_least), keys, "k", "place")
    return rows.where(F.col("place") < first)


# ------------------------------------------------------------------ coherence


def coherence(df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, longest: int = 128, per_unit: float = 1.0, run_of: int = 256) -> DataFrame:
    """Welch magnitude-squared coherence of two columns: ``keys, k, frequency, coherence``.

    Segments of ``min(longest, n // 4)`` rows overlap by half, carry a periodic
    Hann window and lose their mean.  A run of ``run_of`` segments is the unit of
    work and is summed on the spot, so a series of any length is spread over tasks.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_len", F.least(F.lit(longest), F.floor(F.col("_n") / 4)).cast("long")).where(F.col("_len") >= 2)
    n = n.withColumn("_step", F.col("_len") - F.floor(F.col("_len") / 2))
    n = n.withColumn("_count", F.floor((F.col("_n") - F.floor(F.col("_len") / 2)) / F.col("_step")))
    rows = df.select(*keys, idx, F.col(x).alias("_x"), F.col(y).alias("_y")).join(n.drop("_n"), list(keys))
    first = F.greatest(F.ceil((F.col(idx) - F.col("_len") + 1) / F.col("_step")), F.lit(0))
    last = F.least(F.floor(F.col(idx) / F.col("_step")), F.col("_count") - 1)
    rows = rows.where(first <= last).withColumn("_run", F.explode(F.sequence(F.floor(first / run_of), F.floor(last / run_of))))

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        size, step = int(pdf["_len"].iloc[0]), int(pdf["_step"].iloc[0])
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        pieces = ((len(pdf) - size) // step) + 1

        def spectra(c):
            cut = np.lib.stride_tricks.sliding_window_view(pdf[c].to_numpy(float), size)[::step][: min(pieces, run_of)]
            return np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * window, axis=1)

        fx, fy = spectra("_x"), spectra("_y")
        cross = (np.conj(fx) * fy).sum(axis=0)
        power = {"_xx": (np.abs(fx) ** 2).sum(axis=0), "_yy": (np.abs(fy) ** 2).sum(axis=0)}
        return _keyed(pdf, keys, {"k": np.arange(len(cross)), "_len": size, **power, "_re": cross.real, "_im": cross.imag})

    d = DoubleType()
    seg = rows.groupBy(*keys, "_run").applyInPandas(transform, _schema(rows, keys, k=LongType(), _len=LongType(), _xx=d, _yy=d, _re=d, _im=d))
    g = seg.groupBy(*keys, "k").agg(F.max("_len").alias("_len"), *[F.sum(c).alias(c) for c in ("_xx", "_yy", "_re", "_im")])
    coh = F.try_divide(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"), F.col("_xx") * F.col("_yy"))
    return g.select(*keys, "k", (F.col("k") * per_unit / F.col("_len")).alias("frequency"), coh.alias("coherence"))


def coherence_ranking(coh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest and mean coherence with the period of the highest."""
    best = F.min(F.struct((-F.col("coherence")).alias("c"), F.col("k"), F.col("frequency").alias("f")))
    g = coh.groupBy(*keys).agg(best.alias("_b"), F.avg("coherence").alias("mean_coherence"))
    return g.select(*keys, (-F.col("_b.c")).alias("max_coherence"), "mean_coherence", F.when(F.col("_b.f") > 0, 1 / F.col("_b.f")).alias("period_max"))


# ------------------------------------------------------------------ wavelets


def wavelet_power(df: DataFrame, keys: Sequence[str], order: str, value: str, scales: Sequence[float], wavelet: str = "morl") -> DataFrame:
    """Wavelet power of calendar series: ``keys, scale, period, t, power``."""
    rows = df.select(*keys, order, value)
    grid = np.asarray(list(scales), float)
    centre = kernels.WAVELET_CENTRE[wavelet]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        p = np.abs(kernels.cwt(y, grid, wavelet)) ** 2
        s = np.repeat(grid, len(y))
        return _keyed(pdf, keys, {"scale": s, "period": s / centre, "t": np.tile(np.arange(len(y)), len(grid)), "power": p.ravel()})

    d = DoubleType()
    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, scale=d, period=d, t=LongType(), power=d))


def global_power(power: DataFrame, keys: Sequence[str]) -> DataFrame:
    return power.groupBy(*keys, "scale", "period").agg(F.avg("power").alias("global_power"))


def dominant_scale(total: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("global_power")).alias("p"), F.col("scale"), F.col("period")))
    return total.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.scale").alias("scale"), F.col("_b.period").alias("period"), (-F.col("_b.p")).alias("global_power"))


def cross_wavelet(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, scales: Sequence[float], wavelet: str = "cmor1.5-1.0") -> DataFrame:
    """Both transforms of two columns: ``keys, i, period, t, xx, yy, re, im`` with ``re + i im = X conj(Y)``."""
    rows = df.select(*keys, order, x, y)
    grid = np.asarray(list(scales), float)
    centre = kernels.WAVELET_CENTRE[wavelet]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = (kernels.cwt(pdf[c].to_numpy(float), grid, wavelet) for c in (x, y))
        cross = (a * np.conj(b)).ravel()
        n = len(pdf)
        return _keyed(
            pdf,
            keys,
            {
                "i": np.repeat(np.arange(len(grid)), n),
                "period": np.repeat(grid / centre, n),
                "t": np.tile(np.arange(n), len(grid)),
                "xx": (np.abs(a) ** 2).ravel(),
                "yy": (np.abs(b) ** 2).ravel(),
                "re": cross.real,
                "im": cross.imag,
            },
        )

    d = DoubleType()
    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, i=LongType(), period=d, t=LongType(), xx=d, yy=d, re=d, im=d))


def smooth_over_scale(cross: DataFrame, keys: Sequence[str], n_scales: int, width: int = 5) -> DataFrame:
    """Box filter along the scale axis; edges are mirrored, repeating the edge value."""
    half = width // 2
    w = S.by([*keys, "t"], "i").rowsBetween(-half, half)
    mirrored = F.array(F.col("i"), F.when(F.col("i") < half, -1 - F.col("i")), F.when(F.col("i") >= n_scales - half, 2 * n_scales - 1 - F.col("i")))
    rows = cross.withColumn("_to", F.explode(F.filter(mirrored, lambda v: v.isNotNull()))).withColumn("_own", F.col("_to") == F.col("i")).withColumn("i", F.col("_to"))
    return rows.withColumns({c: F.avg(c).over(w) for c in ("xx", "yy", "re", "im")}).where("_own").drop("_to", "_own")


def wavelet_coherence(cross: DataFrame, keys: Sequence[str], n_scales: int, width: int = 5) -> DataFrame:
    """Coherence, phase and the lag it means: ``keys, i, period, t, coherence, phase, lag``."""
    phase = cross.select(*keys, "i", "t", F.atan2("im", "re").alias("phase"))
    s = smooth_over_scale(cross, keys, n_scales, width)
    coh = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("xx") * F.col("yy") + 1e-10)
    out = s.select(*keys, "i", "period", "t", coh.alias("coherence")).join(phase, [*keys, "i", "t"])
    return out.withColumn("lag", F.col("phase") / (2 * np.pi) * F.col("period"))


def strongest(coh: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("coherence")).alias("c"), F.col("i"), F.col("t"), F.col("period"), F.col("phase"), F.col("lag")))
    return coh.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b.c")).alias("max_coherence"), F.col("_b.period").alias("period"), F.col("_b.phase").alias("phase"), F.col("_b.lag").alias("lag")
    )


# ------------------------------------------------------------------ decomposition


def stl(df: DataFrame, keys: Sequence[str], order: str, value: str, period: int = 12, robust: bool = False) -> DataFrame:
    """Seasonal-trend decomposition of calendar series: ``keys, order, trend, seasonal, remainder``."""
    rows = df.select(*keys, order, value)
    order_type = rows.schema[order].dataType

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        trend, season, rest = kernels.stl(pdf[value].to_numpy(float), period, robust=robust)
        return _keyed(pdf, keys, {order: pdf[order].to_numpy(), "trend": trend, "seasonal": season, "remainder": rest})

    d = DoubleType()
    return rows.groupBy(*keys).applyInPandas(run, _schema(rows, keys, **{order: order_type}, trend=d, seasonal=d, remainder=d))


