"""Writers: partitioned samples, stage tables, named result sets, and JSON records of a run."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.text import channel_kind


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Samples partitioned by patient, task and modality; each partition's channels and times are clustered in its files."""
    out = samples.withColumn("modality", channel_kind(F.col("channel")))
    out = out.repartition("patient_id", "task_name", "modality", F.floor(F.col("sample_idx") / 5_000_000)).sortWithinPartitions(
        "patient_id", "task_name", "modality", "channel", "sample_idx")
    out.write.mode(mode).partitionBy("patient_id", "task_name", "modality").parquet(path)


def write_stage(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One stage table; a rerun replaces only the partitions it produces when ``mode`` is overwrite and the table is partitioned."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(f"{root}/{name}")


def write_named(tables: Mapping[str, DataFrame], root: str, csv: Sequence[str] = ()) -> None:
    """Each named table (the sheets of a report) as Parquet, and as CSV with header where asked."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        if name in csv:
            df.write.mode("overwrite").option("header", "true").csv(f"{root}/csv/{name}")


def write_profiles(curves: DataFrame, keys: Sequence[str], path: str, idx: str = "phase_idx", v: str = "v") -> None:
    """Fixed-length curves as one array per key."""
    curves.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, v))), lambda s: s[v]).alias("profile")).write.mode("overwrite").parquet(path)


def write_config(spark: SparkSession, settings: Mapping[str, object], path: str) -> None:
    """The run's settings as one JSON line."""
    spark.createDataFrame([(json.dumps(dict(settings), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def quality_metadata(samples: DataFrame, recording: Sequence[str], channel: str = "channel", t: str = "t", v: str = "v", before: DataFrame | None = None) -> DataFrame:
    """Per recording a JSON list of channel facts (count, duration, min, max, mean, population sd, missing share).

    ``before`` (the samples before resampling) adds the earlier sample counts.
    """
    from strideframe.functions.numeric import finite

    x = finite(F.col(v))
    per = samples.groupBy(*recording, channel).agg(
        F.count(F.lit(1)).alias("n_samples_actual"), F.round(F.max(t) - F.min(t), 3).alias("duration_s"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.round(F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)), 4).alias("nan_ratio"))
    fields = ["n_samples_actual", "duration_s", "min", "max", "mean", "std", "nan_ratio"]
    if before is not None:
        per = per.join(before.groupBy(*recording, channel).agg(F.count(F.lit(1)).alias("n_samples_before_resample")), [*recording, channel], "left")
        fields.append("n_samples_before_resample")
    info = F.struct(F.col(channel).alias("name"), *[F.col(f) for f in fields])
    return per.groupBy(*recording).agg(F.count(F.lit(1)).alias("n_channels"), F.max("duration_s").alias("duration_s"),
                                       F.to_json(F.array_sort(F.collect_list(info)), {"ignoreNullFields": "false"}).alias("channels"))


def run_summary(selected: DataFrame, trajectory: DataFrame, transitions: DataFrame) -> DataFrame:
    """One JSON record of what the selection report shows: k counts, criteria, trajectories and stops. All parts are small tables."""
    k = selected.groupBy("selected_k").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("selected_k", "n"))).alias("x")).scalar()
    crit = selected.groupBy("criterion").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("criterion", "n"))).alias("x")).scalar()
    traj = trajectory.agg(F.array_sort(F.collect_list(F.struct("k", *[c for c in trajectory.columns if c != "k"]))).alias("x")).scalar()
    stops = transitions.agg(F.count(F.lit(1)).alias("n_transitions"), F.count_if("would_stop").alias("n_stopped"), F.min("max_improvement").alias("min_gain"),
                            F.max("max_improvement").alias("max_gain"))
    return stops.select(F.to_json(F.struct(k.alias("k_counts"), crit.alias("by_criterion"), traj.alias("trajectories"), "n_transitions", "n_stopped", "min_gain", "max_gain")).alias("summary"))
