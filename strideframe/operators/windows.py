"""Sliding count windows and their quality gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import TARGET_ROWS, row_index


def window_sizes(length: float, step: float, dt: float) -> tuple[int, int]:
    """Samples per window and per step for a nominal sample spacing (never below one)."""
    dt = dt if dt > 0 else 1.0 / 150.0
    return max(1, int(length / dt + 1e-9)), max(1, int(step / dt + 1e-9))


def expand_windows(indexed: DataFrame, length: Column | int, step: Column | int, out: str = "window_index") -> DataFrame:
    """Give each indexed row the ids of the windows that hold it, at most ceil(length/step) of them.

    Window w holds rows w*step .. w*step+length-1 and exists only when it fits inside the key.
    """
    length = F.lit(length) if isinstance(length, int) else length
    step = F.lit(step) if isinstance(step, int) else step
    lo = F.greatest(F.ceil((F.col("idx") - length + 1) / step), F.lit(0)).cast("long")
    hi = F.least(F.floor(F.col("idx") / step), F.floor((F.col("n") - length) / step)).cast("long")
    ids = F.when((F.col("n") >= length) & (hi >= lo), F.sequence(lo, F.greatest(lo, hi)))
    return indexed.withColumn(out, F.explode(ids))


def sliding_windows(
    df: DataFrame, keys: Sequence[str], order: str, length: int, step: int, tie: Sequence[str] = (), t: str | None = None,
    min_valid: int = 0, valid: Column | None = None, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Window table: keys, window_index, start_s, end_s, center_s, n_samples, n_valid.

    Put a segment column into ``keys`` to forbid windows that cross segments.
    """
    t = t or order
    rows = row_index(df.withColumn("_ok", F.lit(True) if valid is None else valid), keys, order, tie, target_rows)
    out = expand_windows(rows, length, step).groupBy(*keys, "window_index").agg(
        F.min(t).alias("start_s"), F.max(t).alias("end_s"),
        F.count(F.lit(1)).cast("int").alias("n_samples"), F.count_if("_ok").cast("int").alias("n_valid"),
    )
    out = out.withColumn("center_s", (F.col("start_s") + F.col("end_s")) / 2)
    return out.where(F.col("n_valid") >= min_valid)


def windows_inside_segments(windows: DataFrame, segments: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep windows that lie wholly inside one segment.

    A window is contained by a segment exactly when a segment that holds its start also holds its
    end, so the interval join on the start decides it.
    """
    from strideframe.operators.segments import samples_in_segments

    seg = segments.select(*on, F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    hit = samples_in_segments(windows, seg, on, "start_s", "_s", "_e").where(F.col("end_s") <= F.col("_e"))
    return hit.drop("_s", "_e").distinct()


def window_quality(samples: DataFrame, keys: Sequence[str], channel: str, v: str, n_channels: int, samples_from: int = 20, missing_to: float = 0.1,
                   active_share: float = 0.01, active_from: int = 2, level_from: float = 1e-8) -> DataFrame:
    """First failed rule per window, or NULL: ``skip_flag``, ``skip_reason``.

    ``samples`` is long (one row per window, channel, sample); ``n_channels`` is the number of channels
    a window should have, used for the share of missing cells (``missing_to``).  A window needs
    ``samples_from`` samples, ``active_from`` channels of which ``active_share`` is above zero, and a mean of
    ``level_from``.
    """
    per_channel = samples.groupBy(*keys, channel).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(v).alias("_n"),
        F.avg(F.when(F.coalesce(F.col(v), F.lit(0.0)) > 0, 1.0).otherwise(0.0)).alias("_active"),
        F.sum(F.coalesce(F.col(v), F.lit(0.0))).alias("_sum"),
        F.var_pop(F.coalesce(F.col(v), F.lit(0.0))).alias("_var"),
    )
    w = per_channel.groupBy(*keys).agg(
        F.max("_rows").alias("_samples"), F.sum("_rows").alias("_cells"), F.sum("_n").alias("_present"),
        F.count_if(F.col("_active") >= active_share).alias("_n_active"),
        F.sum("_sum").alias("_total"), F.max("_var").alias("_maxvar"),
    )
    size = F.col("_samples") * n_channels
    reason = (
        F.when(F.col("_cells") == 0, "empty")
        .when(1 - F.col("_present") / size > missing_to, "too_many_nans")
        .when(F.col("_samples") < samples_from, "too_few_samples")
        .when(F.col("_n_active") < active_from, "too_few_active_muscles")
        .when(F.col("_total") / size < level_from, "too_low_activation")
        .when(F.col("_maxvar") < 1e-20, "zero_variance")
    )
    return w.select(*keys, F.col("_samples").alias("n_samples"), reason.isNotNull().alias("skip_flag"), reason.alias("skip_reason"))
