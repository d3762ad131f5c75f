"""Channel quality: metrics, score, flag and the cohort reports built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.numeric import div
from strideframe.operators import filters, spectral
from strideframe.operators.filters import BLOCK_ROWS
from strideframe.operators.ordered import TARGET_ROWS, packed_blocks

# --- fixed values: thresholds, weights and bands of the quality rules ------------------------
MIN_SAMPLES = 50
THRESHOLDS = {  # metric: (threshold, points)
    "motion_artifact_ratio": (0.30, 1),
    "offset_ratio": (0.10, 1),
    "drift_ratio": (0.20, 1),
    "clipping_fraction": (0.01, 2),
    "flatline_fraction": (0.05, 2),
    "line_noise_ratio": (0.20, 1),
}
RMS_NEAR_ZERO, RMS_POINTS = 1e-9, 2
BAD_SCORE, WARNING_SCORE = 4, 2
CLIP_TOLERANCE, FLAT_TOLERANCE = 0.005, 0.0001
EMG_BAND, MOTION_BAND, LINE_HALF_WIDTH, DRIFT_HZ = (20.0, 450.0), (1.0, 20.0), 1.0, 5.0
FLAGS = ["ok", "warning", "bad", "too_short"]
TINY = 1e-30
# ----------------------------------------------------------------------------------------------


def time_metrics(df: DataFrame, keys: Sequence[str], order: str, v: str = "v", tie: Sequence[str] = (), fs: float = 1.0,
                 target_rows: int = TARGET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Moments, rms, offset, clipping and flat-line per channel; NULL below 50 samples."""
    blocks = packed_blocks(df.where(F.col(v).isNotNull()), keys, order, v, tie, block_rows, before=1, target_rows=target_rows)
    return _metrics(_summed(blocks, keys, _time_sums(block_rows), _TIME), keys, fs)


def channel_qc(df: DataFrame, keys: Sequence[str], order: str, v: str = "v", tie: Sequence[str] = (), fs: float = 1.0,
               line_hz: float = 50.0, target_rows: int = TARGET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All quality metrics, score and flag per channel.

    Samples are packed into blocks once; whatever a metric needs of a block is a few sums, so no filtered
    samples and no spectra leave their task.
    """
    low = filters.drift_lowpass(fs, DRIFT_HZ)
    segment = max(256, int(fs * 2))
    reach = len(low.response) + low.pad + 1 if low else 1
    blocks = packed_blocks(df.where(F.col(v).isNotNull()), keys, order, v, tie, block_rows, before=reach, after=max(reach, segment), target_rows=target_rows)
    bands = {"emg": (EMG_BAND[0], min(EMG_BAND[1], fs / 2 * 0.95)), "motion": MOTION_BAND, "line": (line_hz - LINE_HALF_WIDTH, line_hz + LINE_HALF_WIDTH)}
    sums = _summed(blocks, keys, _all_sums(block_rows, low, segment, fs, bands), {**_TIME, **_SPECTRAL}).withColumns(
        {f"_{c}": F.col(f"_{c}") / F.when(F.col("_segments") > 0, F.col("_segments")) for c in bands})
    emg = F.when(F.coalesce(F.col("_emg"), F.lit(0.0)) <= 0, F.lit(TINY)).otherwise(F.col("_emg"))
    out = _metrics(sums, keys, fs, {
        "drift_ratio": F.when(F.col("n_samples") >= MIN_SAMPLES, div(F.sqrt(F.col("_trend") / F.col("n_samples")), F.sqrt(F.col("_squares") / F.col("n_samples")), TINY)),
        "motion_artifact_ratio": F.col("_motion") / emg, "line_noise_ratio": F.col("_line") / emg})
    return score(out)


#: What the kernels give for each block; all of it adds up over a key's blocks. `dev` and `dev2` are about the middle of the key's range.
_TIME = {"total": "double", "dev": "double", "dev2": "double", "squares": "double", "clip": "long", "flat": "long"}
_SPECTRAL = {"trend": "double", "segments": "long", "emg": "double", "motion": "double", "line": "double"}


def _time_facts(core: np.ndarray, previous: np.ndarray, lo: float, hi: float) -> tuple:
    """Sums of a block's own rows; ``previous`` is the value before them, or empty."""
    span = max(hi - lo, TINY)
    dev = core - (lo + (hi - lo) / 2)
    steps = np.abs(np.diff(np.concatenate([previous, core])))
    clip = np.count_nonzero(core <= lo + CLIP_TOLERANCE * span) + np.count_nonzero(core >= hi - CLIP_TOLERANCE * span)
    total = np.cumsum(core)[-1]  # value after value, as the SQL adds: means between two roundings depend on it
    return total, dev.sum(), np.square(dev).sum(), np.square(core).sum(), clip, np.count_nonzero(steps < max(FLAT_TOLERANCE * span, TINY))


def _time_sums(rows: int):
    def kernel(x: pd.Series, n: pd.Series, start: pd.Series, block: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        out = []
        for x, n, start, block, lo, hi in zip(x, n, start, block, lo, hi):
            a, b = block * rows - start, min((block + 1) * rows, n) - start
            out.append(_time_facts(x[a:b], x[max(a - 1, 0) : a], lo, hi))
        return pd.DataFrame(out, columns=list(_TIME))

    return kernel


def _all_sums(rows: int, low: filters.Stage | None, segment: int, fs: float, bands: dict[str, tuple[float, float]]):
    def kernel(x: pd.Series, n: pd.Series, start: pd.Series, block: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        weights: dict[int, list] = {}
        out = []
        for x, n, start, block, lo, hi in zip(x, n, start, block, lo, hi):
            a, b = block * rows - start, min((block + 1) * rows, n) - start
            time = _time_facts(x[a:b], x[max(a - 1, 0) : a], lo, hi)
            if n < MIN_SAMPLES:
                out.append((*time, None, 0, *[None] * len(bands)))
                continue
            trend, lost = x, 0
            if low:
                trend, lost = filters._run(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), [low], start == 0, start + len(x) == n)
            nper = min(n, segment)
            step = nper - nper // 2
            # segments that begin in the block's own rows and end in the channel
            begin = np.arange(-(-block * rows // step) * step, min((block + 1) * rows - 1, n - nper) + 1, step) - start
            power = spectral.periodograms(np.lib.stride_tricks.sliding_window_view(x, nper)[begin]).sum(axis=0) / fs if len(begin) else np.zeros(nper // 2 + 1)
            if nper not in weights:
                weights[nper] = [spectral.bin_weights(np.arange(nper // 2 + 1) * fs / nper, *band) for band in bands.values()]
            out.append((*time, np.square(trend[a - lost : b - lost]).sum(), len(begin), *[None if w is None else w @ power for w in weights[nper]]))
        return pd.DataFrame(out, columns=[*_TIME, "trend", "segments", *bands])

    return kernel


def _summed(blocks: DataFrame, keys: Sequence[str], kernel, fields: dict[str, str]) -> DataFrame:
    """keys, n_samples, _lo, _hi and the kernel's sums over the blocks of a key, as `_<field>`."""
    facts = F.pandas_udf(kernel, ", ".join(f"{c} {t}" for c, t in fields.items()))("x", "n", "start", "block", "lo", "hi")
    rows = blocks.select(*keys, "n", "lo", "hi", facts.alias("f"))
    return rows.groupBy(*keys).agg(F.min("n").alias("n_samples"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), *[F.sum(f"f.{c}").alias(f"_{c}") for c in fields])


def _metrics(sums: DataFrame, keys: Sequence[str], fs: float, more: dict[str, Column] | None = None) -> DataFrame:
    n, enough = F.col("n_samples"), F.col("n_samples") >= MIN_SAMPLES
    off, mean = F.col("_dev") / n, F.col("_total") / n
    deviation = F.sqrt(F.greatest(F.col("_dev2") / n - off * off, F.lit(0.0)))
    values = {"signal_mean": mean, "signal_std": deviation, "signal_min": F.col("_lo"), "signal_max": F.col("_hi"), "rms": F.sqrt(F.col("_squares") / n),
              "offset_ratio": div(F.abs(mean), deviation, TINY), "clipping_fraction": F.col("_clip") / n, "flatline_fraction": F.col("_flat") / F.when(n > 1, n - 1)}
    return sums.select(*keys, "n_samples", (n / F.lit(float(fs))).alias("duration_s"), F.lit(float(fs)).alias("fs"),
                       *[F.when(enough, c).alias(name) for name, c in values.items()], *[c.alias(name) for name, c in (more or {}).items()])


def score(metrics: DataFrame) -> DataFrame:
    """Add ``qc_score`` and ``qc_flag`` from the metric columns present; NULL never scores."""
    points: Column = F.lit(0)
    for name, (limit, weight) in THRESHOLDS.items():
        if name in metrics.columns:
            points = points + F.when(F.col(name) > limit, weight).otherwise(0)
    points = points + F.when(F.col("rms") < RMS_NEAR_ZERO, RMS_POINTS).otherwise(0)
    flag = F.when(F.col("n_samples") < MIN_SAMPLES, "too_short").when(F.col("qc_score") >= BAD_SCORE, "bad").when(
        F.col("qc_score") >= WARNING_SCORE, "warning").otherwise("ok")
    return metrics.withColumn("qc_score", points.cast("int")).withColumn("qc_flag", flag)


def summary(qc: DataFrame, by: str) -> DataFrame:
    """Per patient or task: channel count, metric means, flag counts and shares."""
    means = [F.avg(c).alias(c) for c in [*THRESHOLDS, "rms", "qc_score"] if c in qc.columns]
    flags = [F.count_if(F.col("qc_flag") == f).alias(f"n_{f}") for f in ("bad", "warning", "ok")]
    out = qc.groupBy(by).agg(F.count(F.lit(1)).alias("n_channels"), *means, *flags)
    return out.withColumns({"frac_bad": F.col("n_bad") / F.col("n_channels"), "frac_warning": F.col("n_warning") / F.col("n_channels")})


def flag_shares(qc: DataFrame, by: str) -> DataFrame:
    """Flag counts per group and their row shares."""
    counts = qc.groupBy(by).agg(*[F.count_if(F.col("qc_flag") == f).alias(f) for f in FLAGS], F.count(F.lit(1)).alias("_n"))
    return counts.withColumns({f"{f}_frac": F.col(f) / F.col("_n") for f in FLAGS}).drop("_n")


def bad_percent(qc: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """Percent of bad channels per group, highest first (``top`` groups for the report)."""
    out = qc.groupBy(by).agg((F.avg((F.col("qc_flag") == "bad").cast("double")) * 100).alias("bad_pct")).orderBy(F.desc("bad_pct"), by)
    return out.limit(top) if top else out


def worst_channels(qc: DataFrame, keys: Sequence[str], top: int = 50) -> DataFrame:
    """The ``top`` channels by score, clipping and flat-line."""
    return qc.orderBy(F.desc("qc_score"), F.desc("clipping_fraction"), F.desc("flatline_fraction"), *keys).limit(top)


def score_histogram(qc: DataFrame) -> DataFrame:
    """Channels per score and flag."""
    return qc.groupBy("qc_score", "qc_flag").agg(F.count(F.lit(1)).alias("n_channels"))
