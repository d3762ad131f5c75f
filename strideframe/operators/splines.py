"""Missing and bad channels rebuilt from the others by spherical splines over the sensor positions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the spline, terms of its series and what is added to the diagonal; fixed values of the method.
STIFFNESS, TERMS, DIAGONAL = 4, 50, 1e-5
#: Sensors of a recording are one small system; more than this is no sensor layout.
MOST_SENSORS = 4096


def kernel(cosine: np.ndarray, stiffness: int = STIFFNESS, terms: int = TERMS) -> np.ndarray:
    """Sum over n of (2n + 1) / (n (n + 1))^stiffness P_n(cosine) / 4 pi, by the recurrence of the polynomials."""
    before, now, out = np.ones_like(cosine), cosine.copy(), np.zeros_like(cosine)
    for n in range(1, terms + 1):
        out += (2 * n + 1) / (n * (n + 1.0)) ** stiffness * now
        before, now = now, ((2 * n + 1) * cosine * now - n * before) / (n + 1)
    return out / (4 * np.pi)


def weights_of(good: np.ndarray, bad: np.ndarray, stiffness: int = STIFFNESS, terms: int = TERMS, diagonal: float = DIAGONAL) -> np.ndarray:
    """Rows of weights (bad x good) for positions given as rows (x, y, z); only their directions count."""
    good, bad = (p / np.linalg.norm(p, axis=1, keepdims=True) for p in (good, bad))
    n = len(good)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = kernel(np.clip(good @ good.T, -1, 1), stiffness, terms) + diagonal * np.eye(n)
    system[n, n] = 0
    to = np.hstack([kernel(np.clip(bad @ good.T, -1, 1), stiffness, terms), np.ones((len(bad), 1))])
    return np.linalg.lstsq(system, to.T, rcond=None)[0][:n].T


def spline_weights(sensors: DataFrame, keys: Sequence[str], channel: str = "channel", bad: str = "bad", stiffness: int = STIFFNESS, terms: int = TERMS,
                   diagonal: float = DIAGONAL) -> DataFrame:
    """keys, channel (a bad one), source (a good one) and weight, from sensors with x, y, z and a boolean ``bad``.

    Rows without a position or at the origin take no part; a key without good sensors has no weights.
    """
    kinds = ", ".join(f"`{k}` {sensors.schema[k].dataType.simpleString()}" for k in keys)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MOST_SENSORS:
            raise ValueError(f"{key}: {len(rows)} sensors")
        rows = rows.sort_values("name")
        rows = rows[np.linalg.norm(rows[list("xyz")].to_numpy(float), axis=1) > 0]
        good, lost = rows[~rows.lost], rows[rows.lost]
        if good.empty or lost.empty:
            return rows[list(keys)].iloc[:0].assign(channel=pd.Series(dtype=object), source=pd.Series(dtype=object), weight=pd.Series(dtype=float))
        w = weights_of(good[list("xyz")].to_numpy(float), lost[list("xyz")].to_numpy(float), stiffness, terms, diagonal)
        out = {"channel": np.repeat(lost.name.to_numpy(), len(good)), "source": np.tile(good.name.to_numpy(), len(lost)), "weight": w.ravel()}
        return pd.DataFrame({**{k: [v] * w.size for k, v in zip(keys, key)}, **out})

    slim = sensors.dropna(subset=["x", "y", "z"]).select(*keys, F.col(channel).alias("name"), F.coalesce(bad, F.lit(False)).alias("lost"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return slim.groupBy(*keys).applyInPandas(solve, f"{kinds}, channel string, source string, weight double")


def interpolated(samples: DataFrame, weights: DataFrame, keys: Sequence[str], sample: Sequence[str], channel: str = "channel", v: str = "v") -> DataFrame:
    """keys, sample, channel and v of the channels that ``weights`` rebuilds: a weighted sum of the sources of each sample.

    A sample in which a source is missing or null has a null value.
    """
    needed = weights.groupBy(*keys, "channel").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("channel", "_to")
    parts = samples.select(*keys, *sample, F.col(channel).alias("source"), F.col(v).alias("_v"))
    parts = parts.join(weights.withColumnRenamed("channel", "_to"), [*keys, "source"])
    out = parts.groupBy(*keys, *sample, "_to").agg(F.sum(F.col("_v") * F.col("weight")).alias(v), F.count("_v").alias("_found"))
    out = out.join(needed, [*keys, "_to"])
    return out.select(*keys, *sample, F.col("_to").alias(channel), F.when(F.col("_found") == F.col("_n"), F.col(v)).alias(v))


def repaired(samples: DataFrame, sensors: DataFrame, keys: Sequence[str], sample: Sequence[str], channel: str = "channel", v: str = "v", bad: str = "bad") -> DataFrame:
    """All samples of good channels and the rebuilt ones of bad channels, with `rebuilt` to tell them."""
    marks = sensors.select(*keys, F.col(channel), F.coalesce(bad, F.lit(False)).alias("_bad"))
    kept = samples.select(*keys, *sample, channel, v).join(marks, [*keys, channel], "left").where(~F.coalesce("_bad", F.lit(False))).drop("_bad")
    new = interpolated(kept, spline_weights(sensors, keys, channel, bad), keys, sample, channel, v)
    return kept.withColumn("rebuilt", F.lit(False)).select(*keys, *sample, channel, v, "rebuilt").unionByName(new.withColumn("rebuilt", F.lit(True)))
