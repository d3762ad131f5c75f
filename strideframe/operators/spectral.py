"""Welch spectra and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strideframe.functions.numeric import EPS, div
from strideframe.operators.ordered import TARGET_ROWS, row_index
from strideframe.operators.windows import expand_windows


def periodograms(x: np.ndarray) -> np.ndarray:
    """One-sided Hann periodograms of the rows of a matrix, unit sampling rate."""
    n = x.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    spec = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2 / np.sum(hann**2)
    spec[:, 1 : (n + 1) // 2] *= 2
    return spec


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _periodogram(segments: pd.Series) -> pd.Series:
    """Periodograms of short segments; equal lengths go together."""
    out: list = [None] * len(segments)
    by_len: dict[int, list[int]] = {}
    for i, s in enumerate(segments):
        by_len.setdefault(len(s), []).append(i)
    for rows in by_len.values():
        for i, row in zip(rows, periodograms(np.stack([np.asarray(segments.iloc[i], dtype=float) for i in rows]))):
            out[i] = row
    return pd.Series(out)


def feature_segment(n: Column) -> Column:
    """Segment length for cycle features: min(256, n), at least 16."""
    return F.greatest(F.least(F.lit(256), n), F.lit(16)).cast("int")


def qc_segment(n: Column, fs: float) -> Column:
    """Segment length for channel quality: two seconds, at least 256 samples, at most n."""
    return F.least(n, F.greatest(F.lit(256), F.lit(int(fs * 2)))).cast("int")


def welch(df: DataFrame, keys: Sequence[str], order: str, segment, v: str = "v", tie: Sequence[str] = (), fs: float = 1.0,
          min_n: int = 16, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Averaged power spectral density: keys, bin, freq, power, n, nper.

    ``segment`` maps the key's sample count to the segment length.  Segments overlap by half; each is
    a bounded array, so a long channel becomes many small rows and only the average is per key.
    """
    rows = row_index(df.select(*dict.fromkeys([*keys, order, *tie, v])), keys, order, tie, target_rows).where(F.col("n") >= min_n)
    rows = rows.withColumn("_nper", segment(F.col("n")))
    step = F.col("_nper") - F.floor(F.col("_nper") / 2)
    placed = expand_windows(rows, F.col("_nper"), step, "_seg")
    packed = placed.groupBy(*keys, "_seg", "n", "_nper").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(v).cast("double").alias("x")))), lambda s: s["x"]).alias("_x"))
    psd = packed.select(*keys, "n", "_nper", F.posexplode(_periodogram("_x")).alias("bin", "_p"))
    return psd.groupBy(*keys, "bin", "n", "_nper").agg((F.avg("_p") / F.lit(float(fs))).alias("power")).select(
        *keys, "bin", (F.col("bin") * F.lit(float(fs)) / F.col("_nper")).alias("freq"), "power", "n", F.col("_nper").alias("nper"))


def band_power(psd: DataFrame, keys: Sequence[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Trapezoid power in closed frequency bands; NULL when a band holds no bin.

    A key has a bounded number of bins (half a segment), so the bin window is small.
    """
    w = W.partitionBy(*keys).orderBy("bin")
    pf, pp = F.lag("freq").over(w), F.lag("power").over(w)
    rows = psd.withColumn("_pf", pf).withColumn("_area", (F.col("freq") - pf) * (F.col("power") + pp) / 2)
    aggs = []
    for name, (lo, hi) in bands.items():
        inside = F.col("freq").between(lo, hi)
        both = inside & (F.col("_pf") >= lo)
        aggs.append(F.when(F.count_if(inside) > 0, F.coalesce(F.sum(F.when(both, F.col("_area"))), F.lit(0.0))).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def bin_weights(freq: np.ndarray, low: float, high: float) -> np.ndarray | None:
    """What each bin counts in the trapezoid power of a closed band (`band_power`); None when it holds no bin."""
    inside = (freq >= low) & (freq <= high)
    if not inside.any():
        return None
    steps = np.where(inside[1:] & (freq[:-1] >= low), np.diff(freq) / 2, 0.0)
    return np.concatenate([steps, [0.0]]) + np.concatenate([[0.0], steps])


def spectral_features(psd: DataFrame, keys: Sequence[str]) -> DataFrame:
    """dominant_frequency_hz (first maximum) and normalised spectral_entropy per key."""
    whole = W.partitionBy(*keys)
    floor = F.greatest(F.col("power"), F.lit(EPS))
    rows = psd.withColumn("_peak", F.max("power").over(whole)).withColumn("_q", floor / F.sum(floor).over(whole))
    entropy = -F.sum(F.col("_q") * F.log2(F.col("_q") + EPS))
    bins = F.count(F.lit(1))
    flat = F.max("_peak") <= 1e-24
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col("power") == F.col("_peak"), F.col("freq"))).alias("dominant_frequency_hz"),
        F.when(flat, F.lit(0.0)).when(bins >= 2, div(entropy, F.log2(bins.cast("double")))).alias("spectral_entropy"),
    )
