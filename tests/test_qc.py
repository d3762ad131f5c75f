"""Channel quality from packed blocks: the blocks themselves, and the metrics against the row-wise operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import filters, ordered, qc, spectral


@pytest.fixture(scope="module")
def channels(spark):
    rng = np.random.default_rng(5)
    parts = []
    for key, n in (("hot", 5000), ("mid", 700), ("short", 60), ("few", 49), ("one", 1)):
        v = 10 + np.cumsum(rng.normal(size=n)) * 0.2 + rng.normal(size=n)
        parts.append(pd.DataFrame({"k": key, "id": np.arange(n), "t": np.arange(n) // 3, "v": np.round(v, 1)}))
    parts.append(pd.DataFrame({"k": "flat", "id": np.arange(80), "t": 0, "v": 3.5}))
    pdf = pd.concat(parts).reset_index(drop=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=2)).repartition(5).cache()


@pytest.mark.parametrize("rows, before, after, cell, piece", [(64, 5, 9, 100, 16), (50, 120, 70, 10**6, 8192), (7000, 1, 1, 40, 8192), (300, 0, 0, 100, 7)])
def test_packed_blocks_hold_their_rows(channels, monkeypatch, rows, before, after, cell, piece):
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece)
    pdf, df = channels
    got = ordered.packed_blocks(df, ["k"], "t", "v", ["id"], rows, before, after, cell).toPandas()
    for k, want in pdf.sort_values(["k", "t", "id"]).groupby("k")["v"]:
        want, mine = want.to_numpy(), got[got["k"] == k].sort_values("block")
        assert mine["block"].tolist() == list(range(-(-len(want) // rows)))
        for r in mine.itertuples():
            a, b = max(r.block * rows - before, 0), min((r.block + 1) * rows + after, len(want))
            assert (r.start, r.n, r.lo, r.hi) == (a, len(want), want.min(), want.max())
            assert np.array_equal(r.x, want[a:b])


@pytest.mark.parametrize("rows, cell", [(400, 300), (65_536, 10**6)])
def test_quality_equals_filtered_rows_and_spectra(channels, rows, cell):
    pdf, df = channels
    got = qc.channel_qc(df, ["k"], "t", "v", ["id"], fs=150.0, block_rows=rows, target_rows=cell).toPandas().set_index("k")
    trend = filters.filter_channels(df, ["k"], "t", [filters.drift_lowpass(150.0)], "v", ["id"], "y").groupBy("k").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("y"))
    trend = trend.toPandas().set_index("k")["y"]
    psd = spectral.welch(df, ["k"], "t", lambda n: spectral.qc_segment(n, 150.0), "v", ["id"], 150.0, qc.MIN_SAMPLES)
    power = spectral.band_power(psd, ["k"], {"emg": (20.0, 71.25), "motion": (1.0, 20.0), "line": (49.0, 51.0)}).toPandas().set_index("k")
    for k, v in pdf.sort_values(["k", "t", "id"]).groupby("k")["v"]:
        v, row = v.to_numpy(), got.loc[k]
        assert row["n_samples"] == len(v)
        if len(v) < qc.MIN_SAMPLES:
            assert row["qc_flag"] == "too_short" and row[["signal_mean", "rms", "drift_ratio", "motion_artifact_ratio", "flatline_fraction"]].isna().all()
            continue
        span = max(np.ptp(v), qc.TINY)
        want = {"signal_mean": v.mean(), "signal_std": v.std(), "signal_min": v.min(), "signal_max": v.max(), "rms": np.sqrt(np.mean(v * v)),
                "clipping_fraction": (np.sum(v <= v.min() + 0.005 * span) + np.sum(v >= v.max() - 0.005 * span)) / len(v),
                "flatline_fraction": np.mean(np.abs(np.diff(v)) < max(0.0001 * span, qc.TINY)), "drift_ratio": trend[k] / np.sqrt(np.mean(v * v))}
        if k != "flat":  # nothing but rounding is left of its spectrum
            emg = power.loc[k, "emg"]
            want |= {"motion_artifact_ratio": power.loc[k, "motion"] / emg, "offset_ratio": abs(v.mean()) / v.std()}
            want["line_noise_ratio"] = power.loc[k, "line"] / emg
        for name, value in want.items():
            np.testing.assert_allclose(np.nan if row[name] is None else row[name], value, rtol=1e-9, atol=1e-12, err_msg=f"{k} {name}")


def test_samples_are_shuffled_once(spark, channels):
    """Neither one Python group for each channel, nor a copy of every sample for each overlapping segment."""
    _, df = channels
    plan = qc.channel_qc(df, ["k"], "t", "v", ["id"], fs=150.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "_seg#" not in plan and "ArrowEvalPython" in plan
