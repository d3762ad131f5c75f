"""Labelled intervals: building them, joining samples to them, and reading them as phase grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import TARGET_ROWS, adjacent_pairs, row_index
from strideframe.session import stage


def consecutive_segments(marks: DataFrame, keys: Sequence[str], t: str, tie: Sequence[str] = (),
                         target_rows: int = TARGET_ROWS) -> DataFrame:
    """Segments between consecutive marks of a key: ``cycle_index``, ``start_s``, ``end_s``."""
    pairs = adjacent_pairs(marks, keys, t, tie, target_rows=target_rows).select(
        *keys, F.col(f"prev.{t}").alias("start_s"), F.col(f"cur.{t}").alias("end_s")
    )
    return row_index(pairs, keys, "start_s", ("end_s",), target_rows).select(
        *keys, F.col("idx").cast("int").alias("cycle_index"), "start_s", "end_s"
    )


def samples_in_segments(
    samples: DataFrame, segments: DataFrame, on: Sequence[str], t: str = "t", start: str = "start_s", end: str = "end_s",
    bucket_s: float | None = None,
) -> DataFrame:
    """Samples joined to every closed segment that contains them.

    Both sides meet on (keys, time bucket), so the candidates of a hot key spread over its buckets.
    The default bucket is the mean segment length, which bounds the exploded segment rows by three
    per segment on average.
    """
    segments = stage(segments)  # a table of labels: read for its width and for the join
    width: Column = (
        F.lit(float(bucket_s))
        if bucket_s
        else F.greatest(
            segments.agg(F.coalesce(F.avg(F.col(end) - F.col(start)), F.lit(1.0)).alias("w")).scalar(), F.lit(1e-6)
        )
    )
    spread = segments.where(F.col(end) >= F.col(start)).withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))),
    )
    placed = samples.withColumn("_bucket", F.floor(F.col(t) / width).cast("long"))
    inside = (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))
    return placed.join(spread, [*on, "_bucket"]).where(inside).drop("_bucket")


def samples_in_any_segment(samples: DataFrame, segments: DataFrame, on: Sequence[str], t: str = "t",
                           start: str = "start_s", end: str = "end_s") -> DataFrame:
    """The union mask: each sample once if any closed segment contains it."""
    segments = stage(segments)
    width = F.greatest(
        segments.agg(F.coalesce(F.avg(F.col(end) - F.col(start)), F.lit(1.0)).alias("w")).scalar(), F.lit(1e-6)
    )
    spread = segments.where(F.col(end) >= F.col(start)).select(
        *on,
        F.col(start).alias("_s"),
        F.col(end).alias("_e"),
        F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))).alias(
            "_bucket"
        ),
    )
    left = samples.withColumn("_bucket", F.floor(F.col(t) / width).cast("long")).alias("a")
    right = spread.alias("b")
    cond = F.col("a._bucket") == F.col("b._bucket")
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = cond & (F.col(f"a.{t}") >= F.col("b._s")) & (F.col(f"a.{t}") <= F.col("b._e"))
    return left.join(right, cond, "left_semi").drop("_bucket")


def crop(df: DataFrame, t: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rows with lo <= t <= hi; the range filter reaches the scan."""
    if lo is not None:
        df = df.where(F.col(t) >= lo)
    if hi is not None:
        df = df.where(F.col(t) <= hi)
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail at run time when the input is empty, keep it unchanged otherwise."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.where(F.when(n > 0, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def phase_grid(
    df: DataFrame, keys: Sequence[str], t: str = "t", v: str = "v", tie: Sequence[str] = (), points: int | str = 101,
    mode: str = "linear", target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Each key's samples on a common phase grid: (keys, phase_idx, phase, v).

    ``linear`` interpolates between the neighbours, ``asof`` holds the last sample at or before the
    grid point.  Every pair of neighbouring samples emits the grid points between them, so nothing
    is collected.  Keys with fewer than two samples or no time span are left out.  ``points`` may name a
    column with each key's number of points (see `median_points`), which the result keeps.
    """
    if mode not in ("linear", "asof"):
        raise ValueError(f"unknown mode {mode!r}")
    steps = F.col(points) - 1 if isinstance(points, str) else F.lit(points - 1)
    keys = [*keys, points] if isinstance(points, str) else list(keys)
    pairs = adjacent_pairs(df, keys, t, tie, [v], target_rows, with_last=True, with_span=True)
    t0, t1 = F.col(f"first.{t}"), F.col(f"last.{t}")
    pairs = pairs.where(t1 > t0).select(
        *keys,
        ((F.col(f"prev.{t}") - t0) / (t1 - t0)).alias("p0"),
        ((F.col(f"cur.{t}") - t0) / (t1 - t0)).alias("p1"),
        F.col(f"prev.{v}").alias("v0"),
        F.col(f"cur.{v}").alias("v1"),
    )
    lo = F.greatest(F.floor(F.col("p0") * steps).cast("int"), F.lit(0))
    hi = F.least(F.ceil(F.coalesce(F.col("p1"), F.lit(1.0)) * steps).cast("int"), steps.cast("int"))
    grid = pairs.withColumn("phase_idx", F.explode(F.sequence(lo, hi))).withColumn(
        "phase", F.col("phase_idx") / steps.cast("double")
    )
    grid = grid.where((F.col("phase") >= F.col("p0")) & (F.col("p1").isNull() | (F.col("phase") < F.col("p1"))))
    slope = (F.col("v1") - F.col("v0")) * (F.col("phase") - F.col("p0")) / (F.col("p1") - F.col("p0"))
    value = F.col("v0") + slope if mode == "linear" else F.col("v0")
    return grid.select(*keys, "phase_idx", "phase", F.when(F.col("p1").isNull(), F.col("v0")).otherwise(value).alias("v"))


def median_points(samples: DataFrame, task: Sequence[str], cycle: Sequence[str], least: int = 10, out: str = "points") -> DataFrame:
    """``samples`` with the grid length of their task: the median sample count of its cycles, at least ``least``.

    Cycles under ``least`` samples do not count and are left out, as are tasks without any other.
    """
    counts = samples.groupBy(*task, *cycle).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    length = counts.groupBy(*task).agg(F.greatest(F.lit(least), F.floor(F.expr("percentile(_n, 0.5)"))).cast("int").alias(out))
    return samples.join(counts.select(*task, *cycle), [*task, *cycle], "left_semi").join(length, list(task))


def concat_cycles(grid: DataFrame, points: int) -> DataFrame:
    """Cycles laid end to end: one cycle spans 1.0 in ``t_concat``."""
    return grid.withColumn("t_concat", F.col("cycle_index") + F.col("phase_idx") / F.lit(float(points)))
