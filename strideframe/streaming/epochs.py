"""Overlapping epochs over a sample stream, with event time and late-data bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epoch_statistics(samples: DataFrame, keys: Sequence[str], ts: str = "ts", v: str = "v", length: str = "4 seconds", step: str = "2 seconds",
                     late: str = "10 seconds") -> DataFrame:
    """Count, mean, min and max per key and epoch; works on batch and streaming input.

    The event time must be TIMESTAMP (TIMESTAMP_NTZ is cast). State is one partial aggregate per open
    (key, epoch), dropped once the watermark passes it.
    """
    out = samples.withColumn(ts, F.col(ts).cast("timestamp"))
    if out.isStreaming:
        out = out.withWatermark(ts, late)
    agg = out.groupBy(*keys, F.window(ts, length, step)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return agg.select(*keys, F.col("window.start").alias("epoch_start"), "n", "mean", "min", "max")
