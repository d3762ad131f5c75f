"""Labels, demographics, feature tables and stage outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.functions.text import condition_of, find_column, session_of

SEGMENTS = "patient string, task string, channels array<string>, pairs array<struct<start_s: double, end_s: double>>"


def read_segments(spark: SparkSession, path) -> DataFrame:
    """Movement segments from JSON files: patient_id, task_name, cycle_index, start_s, end_s. No pairs, no rows."""
    raw = spark.read.schema(SEGMENTS).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return raw.select(F.col("patient").alias("patient_id"), F.col("task").alias("task_name"), F.posexplode("pairs").alias("cycle_index", "_p")).select(
        "patient_id", "task_name", "cycle_index", "_p.start_s", "_p.end_s")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Typed table, or an empty one when the path does not exist. Malformed content fails the job."""
    try:
        reader = spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", "true").option("mode", "FAILFAST")
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    """Demographics as text columns with the key column named ``id``."""
    df = spark.read.option("header", "true").csv(path)
    key = "id" if "id" in df.columns else find_column(df.columns, ["patient_id", "ID"])
    if key is None:
        raise ValueError("demographics need an id or patient_id column")
    return df.withColumnRenamed(key, "id")


def read_features(spark: SparkSession, path: str, keys: Sequence[str] = ("ID", "timing")) -> DataFrame:
    """Feature CSV with text keys and DOUBLE features; NaN and unparsable become NULL."""
    df = spark.read.option("header", "true").csv(path)
    from strideframe.functions.numeric import finite

    return df.select(*[F.col(k) for k in keys], *[finite(F.col(f"`{c}`").try_cast("double")).alias(c) for c in df.columns if c not in keys])


def read_stage(spark: SparkSession, root: str, name: str, tasks: Sequence[str] = ()) -> DataFrame:
    """A stage table: ``root/name`` when present, else the union of per-task tables ``task/name``."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not tasks:
            raise
    out = spark.read.parquet(f"{tasks[0]}/{name}")
    for t in tasks[1:]:
        out = out.unionByName(spark.read.parquet(f"{t}/{name}"), allowMissingColumns=True)
    return out


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Arrays written by the profile sink, one row per task, window and component."""
    return spark.read.parquet(path)


def entities(df: DataFrame, patient: str = "patient_id", task: str = "task_name", complete: bool = False) -> DataFrame:
    """Distinct patients and tasks with session and condition; ``complete`` keeps tasks that state both."""
    out = df.select(patient, task).distinct().withColumns({"session": session_of(F.col(task)), "condition": condition_of(F.col(task))})
    return out.where("session != '' and condition != ''") if complete else out


def with_segments(recordings: DataFrame, segments: DataFrame, on: Sequence[str] = ("patient_id", "task_name"), present: bool = True) -> DataFrame:
    """Recordings that have (or still lack) segments."""
    return recordings.join(segments.select(*on).distinct(), list(on), "left_semi" if present else "left_anti")


def read_selection(spark: SparkSession, root: str, on: Sequence[str] = ("patient_id", "task_name")) -> DataFrame:
    """Metrics by k with each task's recommendation; a JSON list of channel VAF becomes an array."""
    metrics = spark.read.parquet(f"{root}/metrics_by_k")
    if dict(metrics.dtypes).get("per_muscle_vaf") == "string":
        metrics = metrics.withColumn("per_muscle_vaf", F.from_json("per_muscle_vaf", "array<double>"))
    return metrics.join(spark.read.parquet(f"{root}/recommendations"), list(on), "left")
