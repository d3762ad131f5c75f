"""Consistency checks that return evidence rows, or stop the job when asked to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.text import normal_side


def durations_agree(samples: DataFrame, recording: Sequence[str], channel: str = "channel", t: str = "t", tolerance_s: float = 0.01,
                    fail: bool = False) -> DataFrame:
    """Per recording: the spread of channel durations and whether it stays within the tolerance."""
    per = samples.groupBy(*recording, channel).agg((F.max(t) - F.min(t)).alias("_d"))
    out = per.groupBy(*recording).agg(F.count(F.lit(1)).alias("n_channels"), F.min("_d").alias("min_duration_s"), F.max("_d").alias("max_duration_s"))
    ok = F.col("max_duration_s") - F.col("min_duration_s") <= tolerance_s
    if fail:
        out = out.where(F.when(ok, True).otherwise(F.raise_error(F.lit("channel durations differ")).cast("boolean")))
    return out.withColumn("consistent", ok)


def means_agree(summary: DataFrame, value: str, curves: DataFrame, v: str, keys: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Mean of a summary table against the mean of the curves behind it."""
    a = summary.groupBy(*keys).agg(F.avg(value).alias("summary_mean"))
    b = curves.groupBy(*keys).agg(F.avg(v).alias("curve_mean"))
    return a.join(b, list(keys)).withColumn("consistent", F.abs(F.col("summary_mean") - F.col("curve_mean")) < tolerance)


def unique_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], strict: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """One row per key, first by ``order``; duplicates must agree on ``values`` (strict) or are reported in ``agrees``.

    All duplicates are compared, as a spread per column; the first row is a partial aggregate.
    """
    first = F.min(F.struct(*order, *[c for c in df.columns if c not in (*keys, *order)])).alias("_f")
    spread = [F.coalesce(F.max(v) - F.min(v), F.lit(0.0)) for v in values]
    mixed = [(F.count(v) > 0) & (F.count(v) < F.count(F.lit(1))) for v in values]
    bad = F.lit(False)
    for s, m in zip(spread, mixed):
        bad = bad | (s > tolerance) | m
    out = df.groupBy(*keys).agg(first, bad.alias("_bad"))
    rest = [c for c in df.columns if c not in keys]
    cols = [F.col(f"_f.{c}").alias(c) for c in rest]
    if strict:
        out = out.where(F.when(~F.col("_bad"), True).otherwise(F.raise_error(F.lit("duplicate rows disagree")).cast("boolean")))
        return out.select(*keys, *cols)
    return out.select(*keys, *cols, (~F.col("_bad")).alias("agrees"))


def side_report(demographics: DataFrame, side: str, id_col: str = "id") -> DataFrame:
    """Why rows cannot be classified: totals of missing ids and of missing or unknown sides."""
    s = normal_side(F.col(side))
    return demographics.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(id_col).isNull() | (F.trim(F.col(id_col).cast("string")) == "")).alias("n_missing_id"),
        F.count_if(s.isNull() | (s == "")).alias("n_missing_side"), F.count_if(~s.isin("DX", "SX") & (s != "")).alias("n_unknown_side"),
        F.count_if(s == "DX").alias("n_DX"), F.count_if(s == "SX").alias("n_SX"))


def group_complete(df: DataFrame, keys: Sequence[str], group: str, expected: Sequence[str]) -> DataFrame:
    """Keys that lack one of the expected groups, with what is missing."""
    have = [F.max((F.col(group) == g).cast("int")).alias(f"_{i}") for i, g in enumerate(expected)]
    agg = df.groupBy(*keys).agg(*have)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"_{i}"), F.lit(0)) == 0, g) for i, g in enumerate(expected)]))
    return agg.select(*keys, missing.alias("missing")).where(F.size("missing") > 0)


def first_n_groups(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the first n groups in key order (a cap the user asks for); the group list is limited, not the rows."""
    chosen = df.select(*keys).distinct().orderBy(*keys).limit(n)
    return df.join(chosen, list(keys), "left_semi")


