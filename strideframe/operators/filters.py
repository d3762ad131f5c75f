"""Zero-phase Butterworth filtering, block by block.

The recursive filter is stable, so its impulse response is negligible (1e-17 of its start) after a
length that follows from its slowest pole.  A block padded by that many rows on both sides gives the
same values as filtering the whole channel; the ends of the channel get the usual odd extension.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strideframe.fixed import ENVELOPE_BAND, SMOOTH_HZ
from strideframe.operators.ordered import TARGET_ROWS, blocks, row_index

BLOCK_ROWS = 65_536
MIN_ROWS = 10  # shorter channels pass through


@dataclass(frozen=True)
class Stage:
    """One step of a chain: a filter (impulse response and edge padding) or a pointwise function."""

    name: str
    response: tuple[float, ...] = ()
    pad: int = 0


def _transfer(order: int, cut_hz: Sequence[float], fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth numerator and denominator by pre-warping and the bilinear transform."""
    warped = [2 * fs * math.tan(math.pi * f / fs) for f in cut_hz]
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if len(warped) == 1:
        zeros, poles, gain = np.empty(0, complex), poles * warped[0], warped[0] ** order
    else:
        width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
        half = poles * width / 2
        root = np.sqrt(half**2 - centre2 + 0j)
        zeros, poles, gain = np.zeros(order, complex), np.concatenate([half + root, half - root]), width**order
    c = 2 * fs
    gain = gain * np.real(np.prod(c - zeros) / np.prod(c - poles))
    zeros = np.concatenate([(c + zeros) / (c - zeros), -np.ones(len(poles) - len(zeros))])
    return gain * np.real(np.poly(zeros)), np.real(np.poly((c + poles) / (c - poles)))


def _stage(name: str, order: int, cut_hz: Sequence[float], fs: float) -> Stage:
    b, a = _transfer(order, cut_hz, fs)
    radius = float(np.max(np.abs(np.roots(a))))
    if radius >= 1:
        raise ValueError(f"unstable filter for cut-offs {cut_hz} at {fs} Hz")
    length = int(math.ceil(math.log(1e-17) / math.log(radius))) + 8 * order
    h, hist = [], [0.0] * (len(a) - 1)
    for i in range(length):
        y = (b[i] if i < len(b) else 0.0) - sum(k * p for k, p in zip(a[1:], hist))
        h.append(float(y))
        hist = [y, *hist[:-1]]
    return Stage(name, tuple(h), 3 * max(len(a), len(b)))


def lowpass(fs: float, cutoff_hz: float, order: int = 4) -> Stage:
    """Low-pass; the cut-off is kept within [0.5 Hz, 0.99 Nyquist]."""
    return _stage("lowpass", order, [max(0.5, min(cutoff_hz, fs / 2 * 0.99))], fs)


def drift_lowpass(fs: float, cutoff_hz: float = 5.0, order: int = 4) -> Stage | None:
    """Low-pass for the drift ratio; None (the signal itself) when the cut-off reaches Nyquist."""
    nyq = fs / 2
    return None if cutoff_hz >= nyq else _stage("lowpass", order, [min(max(cutoff_hz / nyq, 1e-6), 0.99) * nyq], fs)


def bandpass(fs: float, low_hz: float, high_hz: float, order: int = 4) -> Stage:
    """Band-pass with cut-offs clipped to [1 Hz, 0.99 Nyquist] and at least 1 Hz apart."""
    low = max(1.0, min(low_hz, fs / 2 * 0.99))
    high = max(low + 1.0, min(high_hz, fs / 2 * 0.99))
    if high >= fs / 2:
        raise ValueError(f"no pass band below Nyquist at fs={fs}")
    return _stage("bandpass", order, [low, high], fs)


def envelope(fs: float, band: tuple[float, float] | None = ENVELOPE_BAND, smooth_hz: float = SMOOTH_HZ, order: int = 4) -> list[Stage]:
    """Band-pass (none to skip it), rectify, low-pass, clamp at zero."""
    out = [bandpass(fs, *band, order)] if band else []
    return [*out, Stage("abs"), lowpass(fs, smooth_hz, order), Stage("clamp")]


def _convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = 1 << (len(x) + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def _run(x: np.ndarray, stages: Sequence[Stage], start: bool, end: bool) -> tuple[np.ndarray, int]:
    """Apply the chain; inner edges lose the rows whose context is incomplete. Returns values and rows lost on the left."""
    lost = 0
    for s in stages:
        if s.name == "abs":
            x = np.abs(x)
        elif s.name == "clamp":
            x = np.maximum(x, 0.0)
        else:
            h, reach = np.asarray(s.response), len(s.response)
            left = 2 * x[0] - x[s.pad : 0 : -1] if start else np.empty(0)
            right = 2 * x[-1] - x[-2 : -s.pad - 2 : -1] if end else np.empty(0)
            ext = np.concatenate([left, x, right])
            warm = np.full(reach, ext[0]) if start else np.empty(0)
            fwd = _convolve(np.concatenate([warm, ext]), h)[len(warm) :]
            warm = np.full(reach, fwd[-1]) if end else np.empty(0)
            both = _convolve(np.concatenate([warm, fwd[::-1]]), h)[len(warm) :][::-1]
            both = both[len(left) : len(both) - len(right)]
            cut_l, cut_r = (0 if start else reach), (0 if end else reach)
            x = both[cut_l : len(both) - cut_r]
            lost += cut_l
    return x, lost


def filter_channels(df: DataFrame, keys: Sequence[str], order: str, stages: Sequence[Stage], v: str = "v", tie: Sequence[str] = (),
                    out: str = "filtered", target_rows: int = TARGET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run a filter chain over each key's ordered samples: keys, order, tie, idx, v, ``out``, ``status``.

    Missing values count as 0.  Channels under ten rows pass through; channels too short for the edge
    padding give NULL and status 'too_short'.
    """
    reach = sum(len(s.response) for s in stages)
    pad = max([s.pad for s in stages], default=0)
    halo = reach + pad + 1
    rows = blocks(row_index(df.select(*dict.fromkeys([*keys, order, *tie, v])), keys, order, tie, target_rows), block_rows, halo, halo)
    fields = [f for f in df.schema.fields if f.name in {*keys, order, *tie, v}]
    schema = T.StructType([*fields, T.StructField("idx", T.LongType()), T.StructField(out, T.DoubleType()), T.StructField("status", T.StringType())])
    names = [f.name for f in fields] + ["idx"]
    chain = tuple(stages)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n, idx = int(pdf["n"].iloc[0]), pdf["idx"].to_numpy()
        x = np.nan_to_num(pdf[v].to_numpy(dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
        core = pdf["core"].to_numpy(dtype=bool)
        res = pdf.loc[core, names].copy()
        if n < MIN_ROWS:
            res[out], res["status"] = x[core], "passthrough"
        elif n <= pad:
            res[out], res["status"] = np.nan, "too_short"
        else:
            y, lost = _run(x, chain, bool(idx[0] == 0), bool(idx[-1] == n - 1))
            res[out], res["status"] = y[idx[core] - idx[0] - lost], "ok"
        res[out] = res[out].astype(object).where(res[out].notna(), None)
        return res

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys, "block").groupBy(*keys, "block").applyInPandas(kernel, schema)
