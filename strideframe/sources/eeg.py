"""EEG side files: sensor layouts, channel types, and the keys in recording names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: units, sensor numbering and recording names --------------------------------
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001}
N_SENSORS, REFERENCE_NUMBER, REFERENCE_NAME = 256, 257, "EEG VREF"
ANNOTATIONS = "EDF Annotations"
FILE_NAME = r"(?i)([A-Za-z]+_\d+)(?:_[FM])?_T(\d)_(\d{8})_(\d{6})(?:_fil)?\.(edf|mff)$"
# ----------------------------------------------------------------------------------------------


def read_sensor_layout(spark: SparkSession, path, unit: str = "cm", complete: bool = True) -> DataFrame:
    """Sensor positions in metres from layout XML: path, channel, number, x, y, z.

    ``complete`` fails the job when a file lacks any of the 256 numbered sensors.
    """
    if unit not in METRES:
        raise ValueError(f"unit must be one of {sorted(METRES)}")
    raw = spark.read.format("xml").option("rowTag", "sensor").schema("number int, x double, y double, z double").load(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), "*").dropna(subset=["number", "x", "y", "z"])
    name = F.when(F.col("number") == REFERENCE_NUMBER, REFERENCE_NAME).otherwise(F.concat(F.lit("EEG "), F.col("number").cast("string")))
    out = rows.select("path", name.alias("channel"), "number", *[(F.col(c) * METRES[unit]).alias(c) for c in "xyz"])
    if not complete:
        return out
    found = out.where(F.col("number").between(1, N_SENSORS)).groupBy("path").agg(F.count_distinct("number").alias("_n"))
    whole = F.when(F.col("_n") == N_SENSORS, True).otherwise(F.raise_error(F.lit("sensor layout lacks numbered sensors")).cast("boolean"))
    return out.join(found, "path", "left").where(whole).drop("_n")


def eeg_channel_type(channel: Column, reference: str = REFERENCE_NAME) -> Column:
    """stim for the annotation track, misc for the reference, eeg for names starting with EEG, else misc."""
    return F.when(channel == ANNOTATIONS, "stim").when(channel == reference, "misc").when(F.upper(channel).startswith("EEG"), "eeg").otherwise("misc")


def file_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """subject, visit ('T0'), stamp ('YYYYMMDD_HHMMSS') and kind of recording files; other names are left out."""
    part = lambda i: F.regexp_extract(path, FILE_NAME, i)
    return files.where(F.col(path).rlike(FILE_NAME)).select(
        part(1).alias("subject"), F.concat(F.lit("T"), part(2)).alias("visit"), F.concat_ws("_", part(3), part(4)).alias("stamp"), F.lower(part(5)).alias("kind"), path)
