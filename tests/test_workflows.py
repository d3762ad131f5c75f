"""The end-to-end plans on small synthetic recordings with a planted change between sessions."""

import numpy as np
import pandas as pd
import pytest

from strideframe.plans import workflows as P
from strideframe.session import stage

MUSCLES = ["Anterior Deltoid", "Posterior Deltoid", "Infraspinatus", "Brachioradialis"]


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(21)
    rows, seg = [], []
    t = np.arange(450) / 150.0
    for p in range(4):
        for s, gain in (("T0", 1.0), ("T1", 1.3)):
            for c in ("DS", "SN"):
                task = f"Task_{s}_{c}"
                seg += [(f"P_{p}", task, i, float(i), i + 0.99) for i in range(3)]
                for m, name in enumerate(MUSCLES):
                    burst = np.abs(np.sin(np.pi * (t % 1) + (m % 2))) * (0.4 + 0.6 * rng.random()) * gain
                    rows.append(pd.DataFrame({"patient_id": f"P_{p}", "task_name": task, "channel": f"{name}: EMG {m + 1}", "t": t, "v": burst * rng.choice([-1, 1], 450)}))
                for a in "XYZ":
                    rows.append(pd.DataFrame({"patient_id": f"P_{p}", "task_name": task, "channel": f"Infraspinatus: Acc 8.{a}", "t": t, "v": np.sin(2 * np.pi * (2 + p) * t * gain) + rng.normal(0, 0.1, 450)}))
    return stage(spark.createDataFrame(pd.concat(rows))), stage(spark.createDataFrame(seg, "patient_id string, task_name string, cycle_index int, start_s double, end_s double"))


@pytest.fixture(scope="module")
def muscle(spark, recordings):
    cycles = P.muscle_cycles(*recordings, MUSCLES, 150.0, 51, band=None)
    vectors = P.sample_vectors(cycles, MUSCLES)
    return cycles, vectors, P.component_counts(vectors, MUSCLES, 3, restarts=2, max_iter=40)


def test_cycles_and_tables(muscle):
    cycles, _, _ = muscle
    assert cycles.count() == 16 * 3 * 4 * 51
    t = P.cycle_tables(cycles, MUSCLES, 51)
    assert t["cycle_muscle"].count() == 16 * 3 * 4 and t["cycle_correlation"].count() == 16 * 3 * 6
    assert t["stability"].count() == 16 * 4 and t["cycle_cci"].where("cci between 0 and 1").count() == 16 * 3


def test_muscle_summary(muscle):
    t = P.cycle_tables(muscle[0], MUSCLES, 51)
    got = P.muscle_summary(t["cycle_muscle"], t["stability"].where("muscle <> 'Infraspinatus'")).toPandas().set_index(["patient_id", "task_name", "muscle"])
    each = t["cycle_muscle"].toPandas().groupby(["patient_id", "task_name", "muscle"])
    assert len(got) == each.ngroups and abs(got["auc"] - each["auc"].mean()).max() < 1e-9
    assert got["cv_auc"].isna().groupby("muscle").all().to_dict() == {m: m == "Infraspinatus" for m in MUSCLES} and set(got["session"]) == {"T0", "T1"}


def test_component_counts(muscle):
    _, _, counts = muscle
    rec = counts["recommendations"].toPandas()
    assert len(rec) == 16 and rec["selected_k"].between(1, 3).all() and counts["failures"].count() == 0
    m = counts["metrics_by_k"].toPandas().sort_values(["patient_id", "task_name", "k"])
    assert len(m) == 48 and (m.groupby(["patient_id", "task_name"])["global_vaf"].diff().dropna() > -1e-6).all()


def test_windows_summaries_and_pairs(muscle):
    cycles, vectors, counts = muscle
    fits = stage(counts["fits"].where("k = 2"))
    w = P.window_tables(vectors, fits, MUSCLES, 51, samples_from=5)
    win = w["windows"].toPandas()
    assert len(win) == 16 * 3 * 9 and not win["skip_flag"].any() and win["global_vaf"].between(0.5, 1).all()
    assert w["window_components"].count() == 16 * 3 * 9 * 2
    t = P.cycle_tables(cycles, MUSCLES, 51)
    comps = P.N.components(fits, P.TASK)
    long = comps.selectExpr("patient_id", "task_name", "comp", "explode(vector) as weight")
    summary = P.task_summary(w["windows"], t["cycle_muscle"], t["stability"], long)
    assert summary.count() == 16 and set(r["session"] for r in summary.collect()) == {"T0", "T1"}
    pairs = P.cohort_pairs(summary, ["mean_global_vaf", "mean_reconstruction_error", "w_sparsity"]).toPandas()
    assert len(pairs) == 8 and pairs["mean_reconstruction_error_ratio"].notna().all()


def test_meta_clusters(muscle):
    _, _, counts = muscle
    out = P.meta_clusters(counts["fits"].where("k = 2"), MUSCLES, 2)
    a = out["assignment"].toPandas()
    assert len(a) == 32 and a["meta_cluster"].isin([0, 1]).all() and (a["similarity"] > 0.5).all()
    assert out["presence"].count() == 32


def test_sensor_features_pair_across_sessions(recordings):
    out = P.sensor_features(*recordings, 150.0)
    assert out["task_features"].count() == 16 * 3
    assert out["paired"].count() == 4 * 2 * 3
    stats = out["stats"].where("feature = 'dominant_frequency_hz'").toPandas()
    assert (stats["n_pairs"] == 12).all() and (stats["mean_change"] > 0).all()


def test_merged_statistics(spark, muscle):
    cycles, _, _ = muscle
    t = P.cycle_tables(cycles, MUSCLES, 51)
    emg = P.with_session(t["cycle_muscle"].groupBy("patient_id", "task_name").agg({"mean_amp": "avg", "peak_amp": "avg"}).withColumnsRenamed({"avg(mean_amp)": "amp", "avg(peak_amp)": "peak"}))
    demo = spark.createDataFrame([(f"P_{i}", s) for i, s in enumerate(("DX", "sinistro", "right", "?"))], "id string, side string")
    out = P.merged_statistics(emg, [], demo, "side", ["amp", "peak"])
    assert out["merged"].columns[:3] == ["patient_id", "session", "condition"]
    stats = out["stats"].toPandas()
    assert len(stats) == 4 and (stats["n_pairs"] == 3).all() and (stats["p_value_fdr"] >= stats["p_value"] - 1e-12).all()


def test_rates_of_channels(recordings):
    samples, segments = recordings
    one, own = (P.sensor_features(s, segments, fs)["task_features"] for s, fs in ((samples, 150.0), (samples.selectExpr("*", "if(task_name like '%DS%', 150.0D, null) as fs"), "fs")))
    a, b = (x.toPandas().sort_values(["patient_id", "task_name", "axis"]).reset_index(drop=True) for x in (one, own))
    assert len(a) == 48 and np.allclose(a["dominant_frequency_hz"], b[a.columns]["dominant_frequency_hz"])
    half = P.sensor_features(samples.selectExpr("*", "if(task_name like '%DS%', 75.0D, 150.0D) as fs"), segments, "fs")["task_features"].toPandas().sort_values(["patient_id", "task_name", "axis"])
    ds = half["task_name"].str.contains("DS").to_numpy()
    assert (half["dominant_frequency_hz"].to_numpy()[ds] < a["dominant_frequency_hz"].to_numpy()[ds]).all()


def test_nearest_centroid_of_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "i int, vector array<double>")
    c = spark.createDataFrame([(0, [0.0, 1.0]), (5, [2.0, 0.1])], "cluster int, vector array<double>")
    got = {r["i"]: r["meta_cluster"] for r in P.M.nearest_centroid(v, c, with_all=True).collect()}
    assert got == {1: 5, 2: None}
    assert P.M.nearest_centroid(v, c.where("cluster > 9")).where("similarity is null").count() == 2
