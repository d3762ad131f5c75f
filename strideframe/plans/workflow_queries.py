"""The end-to-end plans with `events` in the role of recordings: users are patients, event types are muscles or axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.plans import workflows as P
from strideframe.plans.registry import EVENT_TYPES, query, rounded, signals, table

FIT = {"restarts": 2, "max_iter": 20}


def recordings(spark, sf):
    """One task per nation of the user's customer record and half month, all its users' samples in time order."""
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    s = signals(spark, sf).join(cust, "entity")
    half = F.floor(F.col("t") / 1296000)
    task = F.concat(F.lit("Task_"), F.when(half < 1, "T0").otherwise("T1"), F.when(F.col("c_nationkey") % 2 == 0, "_DS").otherwise("_SN"))
    return s.select(F.concat(F.lit("P_"), F.col("c_nationkey").cast("string")).alias("patient_id"), task.alias("task_name"), "channel", (F.col("t") - F.least(half, F.lit(1)) * 1296000).alias("t"), "v")


def thirds(rec):
    """Three cycles of five days per task."""
    cycles = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("cycle_index"), (i * 432000.0).alias("start_s"), ((i + 1) * 432000.0).alias("end_s")))
    return rec.select("patient_id", "task_name").distinct().select("patient_id", "task_name", F.inline(cycles))


def _cycles(spark, sf):
    rec = recordings(spark, sf)
    emg = rec.withColumn("channel", F.concat("channel", F.lit(": EMG 1")))
    return P.muscle_cycles(emg, thirds(rec), EVENT_TYPES, 150.0, 51, band=None, smooth_hz=30.0)


@query("movement_cycle_metrics")
def movement_cycle_metrics(spark, sf):
    """Amplitude and timing of every (task, cycle, muscle)."""
    return rounded(P.cycle_tables(_cycles(spark, sf), EVENT_TYPES, 51)["cycle_muscle"], 5)


@query("movement_component_counts")
def movement_component_counts(spark, sf):
    """Recommended number of components per task."""
    vectors = P.sample_vectors(_cycles(spark, sf), EVENT_TYPES)
    return rounded(P.component_counts(vectors, EVENT_TYPES, 3, **FIT)["recommendations"], 4)


@query("movement_windows")
def movement_windows(spark, sf):
    """Windows with quality and VAF under two fixed components per task."""
    vectors = P.sample_vectors(_cycles(spark, sf), EVENT_TYPES)
    fits = P.N.best_fits(P.N.factorize(vectors, P.TASK, [2], **FIT), P.TASK)
    return rounded(P.window_tables(vectors, fits, EVENT_TYPES, 51, active_from=1, samples_from=10)["windows"], 5)


@query("sensor_feature_stats")
def sensor_feature_stats(spark, sf):
    """Paired feature tests with FDR, event types in the role of accelerometer axes."""
    names = {"click": "Wrist: Acc 1.X", "view": "Wrist: Acc 1.Y", "error": "Wrist: Acc 1.Z", "purchase": "Arm: Acc 2.X", "signup": "Arm: Acc 2.Y"}
    rec = recordings(spark, sf)
    acc = rec.withColumn("channel", F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("channel")])
    return rounded(P.sensor_features(acc, thirds(rec), 150.0)["stats"], 5)
