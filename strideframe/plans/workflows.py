"""End-to-end plans: recordings to muscle features, component counts, cluster activations, sensor features and tests.

Each function returns tables by name and covers all patients and tasks at once.  Results that several
later steps read (filtered signals, cycles, fits) become stage tables; the rest stays lazy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.fixed import COCONTRACTION_PAIRS, ENVELOPE_BAND, FALLBACK_HZ, GAIN, REACHED, SCALE_AT, SMOOTH_HZ
from strideframe.functions.text import acc_axis, acc_sensor, channel_kind, condition_of, session_of
from strideframe.operators import clusters as K
from strideframe.operators import coordination as C
from strideframe.operators import factorize as N
from strideframe.operators import features as X
from strideframe.operators import filters as L
from strideframe.operators import paired as R
from strideframe.operators import resample as Z
from strideframe.operators import reshape as H
from strideframe.operators import segments as S
from strideframe.operators import selection as V
from strideframe.operators import signals as G
from strideframe.operators import similarity as M
from strideframe.operators import windows as W
from strideframe.operators.ordered import row_index
from strideframe.operators.rates import by_rate
from strideframe.session import stage
from strideframe.sources.recordings import RecordingFiles
from strideframe.sources.sinks import quality_metadata, write_named, write_samples

TASK = ["patient_id", "task_name"]
MIN_CYCLE_SAMPLES = 10


def import_recordings(files: RecordingFiles, root: str, rates: Mapping[str, float | None]) -> dict[str, DataFrame]:
    """Parsed exports to one rate for each modality, written under ``root``: samples, channels, quality.

    ``rates`` maps a modality (emg, acc, gyro, other) to its rate; None keeps the samples of a modality as they are, and
    modalities that aren't named are left out.  Returns the written tables.
    """
    key, parts = [*TASK, "channel"], []
    samples = files.samples.withColumn("_kind", channel_kind(F.col("channel")))
    for kind, hz in rates.items():
        own = samples.where(F.col("_kind") == kind).select(*key, "sample_idx", "t", "v")
        parts.append(own if hz is None else Z.fourier_resample(own.drop("sample_idx"), key, "t", hz))
    spark = files.samples.sparkSession
    write_samples(reduce(DataFrame.unionByName, [p.select(*key, "sample_idx", "t", "v") for p in parts]), f"{root}/samples")
    written = spark.read.parquet(f"{root}/samples")
    kept = samples.where(F.col("_kind").isin(*rates))
    write_named({"channels": files.channels, "quality": quality_metadata(written, TASK, before=kept)}, root)
    return {"samples": written, "channels": spark.read.parquet(f"{root}/channels"), "quality": spark.read.parquet(f"{root}/quality")}


def with_session(df: DataFrame) -> DataFrame:
    """Session and condition read from the task name."""
    return df.withColumns({"session": session_of(F.col("task_name")), "condition": condition_of(F.col("task_name"))})


def _task_without_session(name: Column) -> Column:
    return F.array_join(F.filter(F.split(F.trim(name), r"[_\-\s]+"), lambda p: ~F.upper(p).isin("T0", "T1")), "_")


def _rated(rows: DataFrame, columns: Sequence[str], fs: float | str, run) -> DataFrame:
    """``run`` with one rate for all rows, or with the rates of the column that ``fs`` names."""
    return by_rate(rows.select(*columns, fs), fs, run) if isinstance(fs, str) else run(rows.select(*columns), fs)


def muscle_cycles(samples: DataFrame, segments: DataFrame, muscles: Sequence[str], fs: float | str = FALLBACK_HZ, points: int = 101,
                  band: tuple[float, float] | None = ENVELOPE_BAND, smooth_hz: float = SMOOTH_HZ, scale_at: float = SCALE_AT) -> DataFrame:
    """Envelopes of the wanted muscles, scaled per task, on a common phase grid: task, cycle_index, muscle, phase_idx, phase, v."""
    emg = samples.where(channel_kind(F.col("channel")) == "emg")
    position = emg.select(*TASK, "channel").distinct().withColumn("channel_index", F.coalesce(F.regexp_extract("channel", r"(\d+)", 1).try_cast("int"), F.lit(0)))
    names = H.resolve_channels(position, TASK, list(muscles)).select(*TASK, "channel", F.col("wanted").alias("muscle"))
    filtered = lambda rows, hz: L.filter_channels(rows, [*TASK, "channel"], "t", L.envelope(hz, band, smooth_hz), out="_env")
    env = _rated(emg, [*TASK, "channel", "t", "v"], fs, filtered)
    env = env.join(names, [*TASK, "channel"]).select(*TASK, "muscle", "t", F.col("_env").alias("v")).where("v is not null")
    inside = stage(S.samples_in_segments(env, segments.select(*TASK, "cycle_index", "start_s", "end_s"), TASK))
    scale = G.channel_scale(inside, [*TASK, "muscle"], "v", scale_at)
    scaled = G.apply_scale(inside, scale, [*TASK, "muscle"])
    cycle = [*TASK, "cycle_index", "muscle"]
    long_enough = inside.groupBy(*cycle).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_CYCLE_SAMPLES).select(*cycle)
    return stage(S.phase_grid(stage(scaled.join(long_enough, cycle, "left_semi")), cycle, points=points))


def cycle_tables(cycles: DataFrame, muscles: Sequence[str], points: int = 101, pairs: Sequence[tuple[str, str]] = COCONTRACTION_PAIRS) -> dict[str, DataFrame]:
    """Per-cycle amplitude and timing, co-contraction, correlations, and stability over cycles."""
    one = [*TASK, "cycle_index"]
    known = [p for p in pairs if p[0] in muscles and p[1] in muscles]
    out = {
        "cycle_muscle": G.amplitude_timing(cycles, [*one, "muscle"], "phase").drop("cycle_duration_s"),
        "cycle_correlation": C.pairwise_correlation(cycles, one, list(muscles), channel="muscle"),
        "stability": C.stability(cycles, [*TASK, "muscle"], ["cycle_index"], points),
        "cycle_similarity": C.cycle_similarity(cycles, [*TASK, "muscle"], ["cycle_index"]),
    }
    if known:
        out["cycle_cci"] = C.cocontraction(cycles, one, known, points, channel="muscle")
    return out


def sample_vectors(cycles: DataFrame, muscles: Sequence[str]) -> DataFrame:
    """One row per (task, cycle, phase) with the muscles as a vector."""
    cells = [F.coalesce(F.max(F.when(F.col("muscle") == m, F.col("v"))), F.lit(0.0)) for m in muscles]
    return stage(cycles.groupBy(*TASK, "cycle_index", "phase_idx").agg(F.array(*cells).alias("vector")))


def component_counts(vectors: DataFrame, muscles: Sequence[str], most: int = 8, reached: float = REACHED, improvement: float = GAIN, **fit) -> dict[str, DataFrame]:
    """Fits for k = 1..most, their metrics, transitions and the recommended k of every task; ``fit`` goes to `factorize`."""
    fits = N.factorize(vectors, TASK, list(range(1, min(most, len(muscles)) + 1)), **fit)
    best = N.best_fits(fits, TASK)
    channels = N.channel_table(best, TASK, list(muscles))
    metrics = V.vaf_gain(V.fit_summary(channels, TASK), TASK)
    ok = fits.where("status = 'ok'")
    stability = M.restart_stability(N.components(ok, [*TASK, "k", "restart"]), [*TASK, "k"])
    return {
        "fits": best, "metrics_by_k": metrics.join(stability, [*TASK, "k"], "left"), "transitions": V.transitions(channels, TASK, improvement),
        "recommendations": V.select_k(channels, TASK, reached, improvement), "secondary": V.secondary_k(metrics, TASK, reached),
        "failures": fits.where("status <> 'ok'").select(*TASK, "status"),
    }


def window_tables(vectors: DataFrame, chosen: DataFrame, muscles: Sequence[str], points: int = 101, length: float = 0.2, step: float = 0.1, across: bool = False,
                  **gate) -> dict[str, DataFrame]:
    """Sliding windows over the concatenated cycles with activations of the task's fixed components.

    ``chosen`` has one row per task with ``weights`` and ``k``; lengths are in cycles, ``across`` lets windows cross
    cycles, and ``gate`` goes to `window_quality`.
    """
    h = N.activations(vectors, chosen, TASK, ["cycle_index", "phase_idx"])
    rows = vectors.join(h, [*TASK, "cycle_index", "phase_idx"]).withColumn("_pos", F.col("cycle_index") * points + F.col("phase_idx"))
    length, step = W.window_sizes(length, step, 1.0 / points)
    keys = TASK if across else [*TASK, "cycle_index"]
    placed = stage(W.expand_windows(row_index(stage(rows), keys, "_pos"), length, step))
    win = [*keys, "window_index"]
    cells = placed.select(*win, F.posexplode("vector").alias("_i", "v"))
    quality = W.window_quality(cells, win, "_i", "v", len(muscles), **gate)
    energy = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    fit = placed.groupBy(*win).agg((F.min("_pos") / F.lit(float(points))).alias("start_s"), (F.max("_pos") / F.lit(float(points))).alias("end_s"),
                                   F.sum(energy).alias("_sst"), F.sum("squared_error").alias("_sse"), F.count(F.lit(1)).alias("_n"))
    vaf = F.when(F.col("_sst") < 1e-12, 1.0).otherwise(1 - F.col("_sse") / F.when(F.col("_sst") >= 1e-12, F.col("_sst")))
    windows = quality.join(fit, win).select(
        *win, "start_s", "end_s", ((F.col("start_s") + F.col("end_s")) / 2).alias("center_s"), "n_samples", "skip_flag", "skip_reason",
        F.when(~F.col("skip_flag"), vaf).alias("global_vaf"), F.when(~F.col("skip_flag"), F.col("_sse") / (F.col("_n") * len(muscles))).alias("reconstruction_error"))
    act = placed.select(*win, "_pos", F.posexplode("h").alias("comp", "h"))
    act = act.join(quality.where(~F.col("skip_flag")).select(*win), win, "left_semi")
    act = row_index(act, [*win, "comp"], "_pos").withColumn("sample_idx", F.col("idx")).drop("idx", "n", "_pos")
    summary = G.activation_summary(act, [*win, "comp"])
    return {"windows": windows, "activations": act, "window_components": summary}


def task_summary(windows: DataFrame, cycle_muscle: DataFrame, stability: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """One row per task: means over valid windows, cycles and muscles."""
    w = windows.groupBy(*TASK).agg(F.count_if(~F.col("skip_flag")).alias("n_valid_windows"), F.avg("global_vaf").alias("mean_global_vaf"),
                                   F.avg("reconstruction_error").alias("mean_reconstruction_error"))
    c = cycle_muscle.groupBy(*TASK).agg(*[F.avg(s).alias(d) for s, d in (
        ("mean_amp", "mean_cycle_mean_amp"), ("peak_amp", "mean_cycle_peak_amp"), ("auc", "mean_cycle_auc"), ("duration", "mean_cycle_duration"), ("centroid", "mean_cycle_centroid"))])
    s = stability.groupBy(*TASK).agg(*[F.avg(x).alias(f"mean_{x}") for x in ("cv_mean_amp", "cv_peak_amp", "cv_auc")], F.avg("mean_similarity_to_mean_cycle").alias("mean_similarity_to_mean_cycle"))
    out = w.join(c, TASK, "left").join(s, TASK, "left")
    if components is not None:
        out = out.join(M.sparsity(components, TASK), TASK, "left")
    return with_session(out)


def muscle_summary(cycle_muscle: DataFrame, stability: DataFrame) -> DataFrame:
    """One row per (task, muscle): means over cycles of amplitude and timing, with the muscle's stability over cycles where there is any."""
    means = cycle_muscle.groupBy(*TASK, "muscle").agg(*[F.avg(c).alias(c) for c in ("mean_amp", "peak_amp", "auc", "onset", "offset", "duration", "centroid")])
    kept = [c for c in ("cv_mean_amp", "cv_peak_amp", "cv_auc", "mean_similarity_to_mean_cycle", "std_similarity_to_mean_cycle") if c in stability.columns]
    return with_session(means.join(stability.select(*TASK, "muscle", *kept), [*TASK, "muscle"], "left"))


def cohort_pairs(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """T0, T1 and delta per patient and condition, with the error ratio when present."""
    out = R.pair_sessions(summary.where("session != '' and condition != ''"), ["patient_id", "condition"], "session", metrics)
    return R.with_ratio(out, "mean_reconstruction_error") if "mean_reconstruction_error" in metrics else out


def meta_clusters(fits: DataFrame, muscles: Sequence[str], n_clusters: int = 4, weighted: bool = False) -> dict[str, DataFrame]:
    """Cluster all tasks' components and assign every component to its nearest centroid."""
    w = N.components(fits, TASK).select(*TASK, "comp", F.posexplode("vector").alias("_i", "weight"))
    w = w.withColumn("channel", F.array(*[F.lit(m) for m in muscles])[F.col("_i")])
    stacked = stage(M.stack_components(w, TASK))
    _, centroids, _ = K.fit_clusters(stacked, n_clusters, weight="sample_weight" if weighted else None)
    assigned = with_session(M.nearest_centroid(stacked, centroids, with_all=True))
    return {"centroids": centroids, "assignment": assigned, "presence": K.presence(assigned, [*TASK, "session", "condition"], n_clusters)}


def sensor_features(samples: DataFrame, segments: DataFrame, fs: float | str = FALLBACK_HZ, lowpass_hz: float = 10.0, min_cycles: int = 2) -> dict[str, DataFrame]:
    """Accelerometer features per cycle and their means per task, sensor and axis, paired over sessions and tested.

    Tasks pair on their name without the session; tests are per condition, FDR within each feature.
    """
    acc = samples.withColumns({"sensor": acc_sensor(F.col("channel")), "axis": acc_axis(F.col("channel"))}).where("sensor is not null")
    key = [*TASK, "sensor", "axis"]
    filtered = lambda rows, hz: L.filter_channels(rows, key, "t", [L.lowpass(hz, lowpass_hz)], out="_y")
    rate = [fs] if isinstance(fs, str) else []
    smooth = _rated(acc, [*key, "t", "v"], fs, filtered).select(*key, "t", F.col("_y").alias("v"), *rate).where("v is not null")
    inside = stage(S.samples_in_segments(smooth, segments.select(*TASK, "cycle_index", "start_s", "end_s"), TASK))
    measured = lambda rows, hz: X.cycle_features(rows, [*key, "cycle_index"], fs=hz)
    per_cycle = stage(_rated(inside, [*key, "cycle_index", "t", "v"], fs, measured).drop(*rate))
    per_task = stage(with_session(X.aggregate_cycles(per_cycle, key, min_cycles)))
    paired = R.pair_sessions(per_task.withColumn("task", _task_without_session(F.col("task_name"))), ["patient_id", "task", "condition", "sensor", "axis"], "session", X.FEATURES)
    long = None
    paired = stage(paired)
    for f in X.FEATURES:
        part = paired.select("condition", F.lit(f).alias("feature"), F.col(f"{f}_T0").alias("v0"), F.col(f"{f}_T1").alias("v1"))
        long = part if long is None else long.unionByName(part)
    stats = R.bh_fdr(R.paired_t(long, ["feature", "condition"]), ["feature"], "p_value", ["condition"], "p_value_fdr")
    return {"cycle_features": per_cycle, "task_features": per_task, "paired": paired, "stats": stats}


def merged_statistics(emg: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]], demographics: DataFrame, side: str, metrics: Sequence[str], group: str = "recoded_group",
                      alpha: float = 0.05) -> dict[str, DataFrame]:
    """Fuse feature tables with demographics, recode to the affected side, and test every metric per group."""
    wide = H.fuse(emg, [*parts, (demographics.withColumnRenamed("id", "patient_id"), ["patient_id"])], ["patient_id", "session", "condition"])
    recoded = H.recode(wide, "condition", side, out=group)
    long = R.unpivot_metrics(recoded, ["patient_id", "session", group], list(metrics))
    pairs = R.pair_sessions(long, ["metric", group, "patient_id"], "session", ["value"]).select("metric", group, F.col("value_T0").alias("v0"), F.col("value_T1").alias("v1"))
    tests = R.bh_fdr(R.paired_tests(pairs.where(F.col(group).isNotNull()), ["metric", group]), [group], "p_value", ["metric"], "p_value_fdr")
    return {"merged": wide, "recoded": recoded, "metric_groups": H.profile_metrics(wide), "stats": tests.withColumn("significant", F.coalesce(F.col("p_value_fdr") < alpha, F.lit(False)))}
