"""Agreement between channels and between cycles on a common phase grid.

Channel lists are fixed configuration (a dozen names), so pairs become aggregate expressions over a
pivoted grid: no self join, no pair rows before the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.numeric import EPS, corr_guarded, div

PAIRS_AT_ONCE = 1024


def pivot_channels(grid: DataFrame, keys: Sequence[str], sample: str, channel: str, v: str, channels: Sequence[str]) -> DataFrame:
    """One row per (keys, sample) with one column c0, c1, ... per listed channel."""
    cols = [F.max(F.when(F.col(channel) == c, F.col(v))).alias(f"c{i}") for i, c in enumerate(channels)]
    return grid.where(F.col(channel).isin(*channels)).groupBy(*keys, sample).agg(*cols)


def _explode_pairs(wide: DataFrame, keys: Sequence[str], names: Sequence[tuple[str, str]], values: Sequence[Column], out: str) -> DataFrame:
    if len(values) > PAIRS_AT_ONCE:  # more pairs than one aggregation should have columns
        parts = [slice(i, i + PAIRS_AT_ONCE) for i in range(0, len(values), PAIRS_AT_ONCE)]
        return reduce(DataFrame.unionByName, [_explode_pairs(wide, keys, names[p], values[p], out) for p in parts])
    agg = wide.groupBy(*keys).agg(*[v.alias(f"_p{i}") for i, v in enumerate(values)])
    rows = F.array(*[F.struct(F.lit(a).alias("channel_a"), F.lit(b).alias("channel_b"), F.col(f"_p{i}").alias(out)) for i, (a, b) in enumerate(names)])
    return agg.select(*keys, F.inline(rows))


def pairwise_correlation(grid: DataFrame, keys: Sequence[str], channels: Sequence[str], sample: str = "phase_idx", channel: str = "channel",
                         v: str = "v", out: str = "corr") -> DataFrame:
    """Pearson r of every unordered channel pair per key; NULL when either side is constant."""
    wide = pivot_channels(grid, keys, sample, channel, v, channels)
    idx = list(combinations(range(len(channels)), 2))
    both = [(F.when(F.col(f"c{j}").isNotNull(), F.col(f"c{i}")), F.when(F.col(f"c{i}").isNotNull(), F.col(f"c{j}"))) for i, j in idx]
    return _explode_pairs(wide, keys, [(channels[i], channels[j]) for i, j in idx], [corr_guarded(a, b) for a, b in both], out)


def cocontraction(grid: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], points: int, sample: str = "phase_idx",
                  channel: str = "channel", v: str = "v") -> DataFrame:
    """2*area(min(x, y)) / (area(x) + area(y)) per key and channel pair, on a complete grid of ``points``."""
    channels = sorted({c for p in pairs for c in p})
    at = {c: F.col(f"c{i}") for i, c in enumerate(channels)}
    wide = pivot_channels(grid, keys, sample, channel, v, channels)
    end = F.col(sample).isin(0, points - 1)
    weight = F.when(end, 0.5).otherwise(1.0) / F.lit(float(points - 1))
    values = []
    for a, b in pairs:
        x, y = at[a], at[b]
        ok = x.isNotNull() & y.isNotNull()
        low, total = F.sum(F.when(ok, F.least(x, y) * weight)), F.sum(F.when(ok, (x + y) * weight))
        values.append(div(2 * low, total, EPS))
    return _explode_pairs(wide, keys, list(pairs), values, "cci")


def cycle_similarity(grid: DataFrame, keys: Sequence[str], cycle: Sequence[str], sample: str = "phase_idx", v: str = "v") -> DataFrame:
    """r between each cycle and the mean cycle of its key."""
    mean = grid.groupBy(*keys, sample).agg(F.avg(v).alias("_mean"))
    return grid.join(mean, [*keys, sample]).groupBy(*keys, *cycle).agg(
        corr_guarded(F.col(v), F.col("_mean")).alias("similarity_to_mean_cycle"))


def stability(grid: DataFrame, keys: Sequence[str], cycle: Sequence[str], points: int, sample: str = "phase_idx", v: str = "v") -> DataFrame:
    """Per key: coefficient of variation of cycle mean, peak and AUC, and mean and sd of cycle similarity."""
    end = F.col(sample).isin(0, points - 1)
    per_cycle = grid.groupBy(*keys, *cycle).agg(
        F.avg(v).alias("_mean"), F.max(v).alias("_peak"),
        F.sum(F.col(v) * F.when(end, 0.5).otherwise(1.0) / F.lit(float(points - 1))).alias("_auc"))

    def cv(c: str) -> Column:
        return div(F.stddev_pop(c), F.avg(c), EPS)

    amp = per_cycle.groupBy(*keys).agg(cv("_mean").alias("cv_mean_amp"), cv("_peak").alias("cv_peak_amp"), cv("_auc").alias("cv_auc"))
    sim = cycle_similarity(grid, keys, cycle, sample, v).groupBy(*keys).agg(
        F.avg("similarity_to_mean_cycle").alias("mean_similarity_to_mean_cycle"),
        F.stddev_pop("similarity_to_mean_cycle").alias("std_similarity_to_mean_cycle"))
    return amp.join(sim, list(keys))


def symmetric_matrix(pairs: DataFrame, keys: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
    """Pair list to a full matrix: one row per (keys, channel_a), one column per name, 1 on the diagonal."""
    flipped = pairs.select(*keys, F.col("channel_b").alias("channel_a"), F.col("channel_a").alias("channel_b"), value)
    both = pairs.select(*keys, "channel_a", "channel_b", value).unionByName(flipped)
    cells = [F.when(F.first("channel_a") == n, 1.0).otherwise(F.max(F.when(F.col("channel_b") == n, F.col(value)))).alias(n) for n in names]
    return both.groupBy(*keys, "channel_a").agg(*cells)
