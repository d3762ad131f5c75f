"""Cleaning of resting EEG: filters, robust reference, rebuilt channels, components taken out, epochs rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators import filters as L
from strideframe.operators import reference, rejection, splines, unmixing
from strideframe.operators import resample as Z
from strideframe.operators.coordination import pivot_channels
from strideframe.session import stage

# --- fixed values: settings of the cleaning chain -----------------------------------------------
MAINS_HZ, BAND_HZ, LAST_LOWPASS_HZ, TARGET_HZ = 50.0, (1.0, 100.0), 30.0, 256.0
EPOCH_S, OVERLAP, KEPT_VARIANCE = 4.0, 0.5, 0.99
# ----------------------------------------------------------------------------------------------


def spiky_components(wide: DataFrame, fits: DataFrame, keys: Sequence[str], channels: Sequence[str], limit: float) -> DataFrame:
    """keys and component of the components whose excess kurtosis exceeds ``limit``, as blinks and movements do."""
    values = unmixing.sources(wide, fits, keys, channels).select(*keys, F.posexplode("sources").alias("component", "_s"))
    return values.groupBy(*keys, "component").agg(F.kurtosis("_s").alias("_k")).where(F.col("_k") > limit).drop("_k")


def _filtered(samples: DataFrame, key: Sequence[str], stages: list) -> DataFrame:
    return L.filter_channels(samples, key, "t", stages).select(*key, "t", "idx", "v", "filtered")


def clean_eeg(samples: DataFrame, sensors: DataFrame, channels: Sequence[str], fs: float, keys: Sequence[str] = ("path",), target_hz: float | None = TARGET_HZ,
              mains_hz: float | None = MAINS_HZ, band: tuple[float, float] = BAND_HZ, lowpass_hz: float = LAST_LOWPASS_HZ, spiky: float = 20.0,
              limit: float = reference.LIMIT, least_corr: float = reference.LEAST_CORR, folds: int = 5, candidates: int = 10, consensus: float = 0.4) -> dict[str, DataFrame]:
    """From samples (keys, channel, t, v) and sensors (keys, channel, x, y, z): clean, bad, fits, dropped, thresholds and epochs.

    All channels of a recording have the same times.  In this order: the mains line (what a narrow band-pass lets
    through is subtracted), the band, the rate, channels left out of the robust reference, the reference, splines for
    those channels, independent components (as many as hold KEPT_VARIANCE) without the spiky ones, a last low-pass, and
    epochs with half overlap judged by cross-validated thresholds.  A trained classifier of components isn't part of it:
    the rule is excess kurtosis above ``spiky``; pass infinity to keep all, and use `unmixing` with own labels instead.
    `clean` has keys, channel, idx, t and v; `epochs` has keys, epoch, n_channels, n_bad and rejected.
    """
    keys = list(keys)
    key = [*keys, "channel"]
    rows = samples.where(F.col("channel").isin(*channels)).select(*key, "t", "v")
    if mains_hz and mains_hz + 1 < fs / 2:
        rows = _filtered(rows, key, [L.bandpass(fs, mains_hz - 1, mains_hz + 1)]).select(*key, "t", (F.col("v") - F.col("filtered")).alias("v"))
    rows = stage(_filtered(rows, key, [L.bandpass(fs, *band)]).select(*key, "t", F.col("filtered").alias("v")))
    if target_hz and target_hz < fs:
        rows, fs = stage(Z.fourier_resample(rows, key, "t", target_hz).select(*key, "t", "v")), target_hz
    ends = rows.groupBy(*keys).agg(F.min("t").alias("_t0"))
    rows = rows.join(ends, keys).withColumn("idx", F.round((F.col("t") - F.col("_t0")) * fs).cast("long")).drop("_t0")
    names = [f"c{i}" for i in range(len(channels))]
    to_name = F.create_map(*[F.lit(x) for n, c in zip(names, channels) for x in (n, c)])
    wide = stage(pivot_channels(rows, [*keys, "t"], "idx", "channel", "v", channels))
    marks = stage(reference.bad_channels(wide, keys, names, "idx", limit=limit, least_corr=least_corr))
    aside = reference.referenced(wide, marks, keys, names).drop("reference")
    long = aside.unpivot([*keys, "idx", "t"], names, "name", "v").select(*key[:-1], to_name[F.col("name")].alias("channel"), "idx", "t", "v")
    bad = marks.select(*keys, to_name[F.col("channel")].alias("channel"), "bad", "why", "deviation", "roughness", "best_corr")
    placed = sensors.join(bad.select(*key, "bad"), key)
    whole = splines.repaired(long, placed, keys, ["idx", "t"])
    wide = stage(pivot_channels(whole, [*keys, "t"], "idx", "channel", "v", channels))
    fits = stage(unmixing.unmix(wide, keys, names, share=KEPT_VARIANCE))
    dropped = stage(spiky_components(wide, fits, keys, names, spiky))
    parts = unmixing.without_components(wide, fits, dropped, keys, names)
    long = parts.unpivot([*keys, "idx", "t"], names, "name", "v").select(*keys, to_name[F.col("name")].alias("channel"), "idx", "t", "v")
    clean = stage(_filtered(long, key, [L.lowpass(fs, lowpass_hz)]).select(*key, "idx", "t", F.col("filtered").alias("v")))
    cut = Z.epochs(clean, key, "t", EPOCH_S, OVERLAP)
    first = clean.groupBy(*keys).agg(F.min("t").alias("_t0"))
    cut = cut.join(first, keys).withColumn("pos", F.round((F.col("t") - F.col("_t0") - F.col("epoch_start_s")) * fs).cast("int"))
    cut = stage(cut.select(*key, "epoch", "pos", "v"))
    thresholds = stage(rejection.rejection_thresholds(cut, key, folds=folds, candidates=candidates))
    return {"clean": clean, "bad": bad, "fits": fits, "dropped": dropped, "thresholds": thresholds, "epochs": rejection.epoch_marks(cut, thresholds, keys, consensus=consensus)}
