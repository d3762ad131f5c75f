"""Goodness of fit by number of components, and the rules that pick the number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.fixed import GAIN, REACHED
from strideframe.functions.numeric import EPS

ISCLOSE_RTOL, ISCLOSE_ATOL = 1e-5, 1e-8  # fixed values: tie tolerance of the worst channel


def explained(df: DataFrame, keys: Sequence[str], channel: str, x: str, fit: str, zero_energy: float | None = None,
              floor: float = 1e-10) -> DataFrame:
    """Uncentred variance accounted for per (keys, channel): ``vaf``, sst, sse, n.

    Channels with energy at or below ``floor`` give ``zero_energy`` (NULL or 1.0).
    """
    e = F.col(x) - F.col(fit)
    agg = df.groupBy(*keys, channel).agg(F.sum(F.col(x) * F.col(x)).alias("sst"), F.sum(e * e).alias("sse"), F.count(F.lit(1)).alias("n"))
    low = F.col("sst") <= floor
    return agg.withColumn("vaf", F.when(low, F.lit(zero_energy).cast("double")).otherwise(1 - F.col("sse") / F.when(~low, F.col("sst"))))


def fit_summary(channels: DataFrame, keys: Sequence[str], k: str = "k") -> DataFrame:
    """Global VAF, mean and least channel VAF, RSS, AIC and BIC per (keys, k) from per-channel rows."""
    agg = channels.groupBy(*keys, k).agg(
        F.sum("sst").alias("_sst"), F.sum("sse").alias("rss"), F.max("n").alias("n_samples"), F.count(F.lit(1)).alias("n_channels"),
        F.avg("vaf").alias("mean_channel_vaf"), F.min("vaf").alias("min_channel_vaf"), F.count("vaf").alias("n_valid_channels"))
    m, s = F.col("n_channels").cast("double"), F.col("n_samples").cast("double")
    params = F.greatest(F.col(k) * (m + s) - F.col(k) * F.col(k), F.lit(0.0))
    cells = m * s
    fit = cells * F.ln(F.greatest(F.col("rss"), F.lit(EPS)) / cells)
    return agg.select(
        *keys, k, F.when(F.col("_sst") < EPS, 1.0).otherwise(1 - F.col("rss") / F.when(F.col("_sst") >= EPS, F.col("_sst"))).alias("global_vaf"),
        "mean_channel_vaf", "min_channel_vaf", "rss", (fit + 2 * params).alias("aic"), (fit + F.ln(cells) * params).alias("bic"),
        "n_samples", "n_channels", "n_valid_channels")


def transitions(channels: DataFrame, keys: Sequence[str], improvement: float = GAIN, channel: str = "channel", k: str = "k") -> DataFrame:
    """Per k: the worst channel(s), and whether all of them gain at most ``improvement`` when going to k+1.

    Windows run over one channel's few k values, or one k's few channels.
    """
    by_k = W.partitionBy(*keys, channel).orderBy(k)
    rows = channels.withColumn("_next", F.when(F.lead(k).over(by_k) == F.col(k) + 1, F.lead("vaf").over(by_k)))
    whole = W.partitionBy(*keys, k)
    rows = rows.withColumn("_min", F.min("vaf").over(whole))
    worst = F.abs(F.col("vaf") - F.col("_min")) <= ISCLOSE_ATOL + ISCLOSE_RTOL * F.abs("_min")
    gain = F.when(worst, F.col("_next") - F.col("vaf"))
    agg = rows.groupBy(*keys, k).agg(
        F.max("_min").alias("min_valid_vaf"), F.count("vaf").alias("n_valid"), F.count_if(F.col("vaf").isNull()).alias("n_invalid"),
        F.array_sort(F.collect_list(F.when(worst, F.col(channel)))).alias("worst_channels"),
        F.count_if(worst).alias("_worst"), F.count(gain).alias("_gains"), F.max(gain).alias("max_improvement"), F.count("_next").alias("_next_valid"))
    stop = (F.col("_worst") > 0) & (F.col("_gains") == F.col("_worst")) & (F.col("max_improvement") <= improvement) & (F.col("_next_valid") > 0)
    return agg.select(*keys, k, (F.col(k) + 1).alias("k_next"), "min_valid_vaf", "worst_channels", "max_improvement",
                      F.coalesce(stop, F.lit(False)).alias("would_stop"), "n_valid", "n_invalid")


def select_k(channels: DataFrame, keys: Sequence[str], reached: float = REACHED, improvement: float = GAIN, channel: str = "channel",
             k: str = "k") -> DataFrame:
    """First k where every valid channel reaches the threshold (C) or the worst ones stop gaining (D), else the largest k (F)."""
    t = transitions(channels, keys, improvement, channel, k)
    c = F.coalesce(F.col("min_valid_vaf") >= reached, F.lit(False))
    agg = t.groupBy(*keys).agg(F.min(F.when(c, F.col(k))).alias("_c"), F.min(F.when(F.col("would_stop"), F.col(k))).alias("_d"),
                               F.max(k).alias("_kmax"), F.max("n_valid").alias("_valid"))
    is_c = F.col("_c").isNotNull() & (F.col("_d").isNull() | (F.col("_c") <= F.col("_d")))
    code = F.when(is_c, "C").when(F.col("_d").isNotNull(), "D").otherwise("F")
    chosen = F.when(is_c, F.col("_c")).otherwise(F.coalesce("_d", "_kmax"))
    reason = (
        F.when(F.col("_valid") == 0, "no_valid_channels")
        .when(code == "C", "all_valid_channels_reached_threshold")
        .when(code == "D", "worst_channels_stopped_improving")
        .otherwise("largest_k")
    )
    picked = agg.select(*keys, chosen.alias("selected_k"), code.alias("criterion"), reason.alias("reason"))
    audit = t.select(*keys, F.col(k).alias("selected_k"), F.col("min_valid_vaf").alias("selected_min_vaf"), F.col("worst_channels").alias("selected_worst_channels"))
    return picked.join(audit, [*keys, "selected_k"]).select(*picked.columns, "selected_min_vaf", "selected_worst_channels")


def vaf_gain(summary: DataFrame, keys: Sequence[str], k: str = "k") -> DataFrame:
    """Gain in global VAF over k-1, NULL when that fit is missing."""
    w = W.partitionBy(*keys).orderBy(k)
    prev = F.when(F.lag(k).over(w) == F.col(k) - 1, F.lag("global_vaf").over(w))
    return summary.withColumn("delta_vaf", F.col("global_vaf") - prev)


def secondary_k(summary: DataFrame, keys: Sequence[str], threshold: float = REACHED, k: str = "k") -> DataFrame:
    """Reporting choices: least AIC, least BIC, smallest k over the global threshold (else the largest k)."""
    w = W.partitionBy(*keys)
    rows = summary.withColumns({"_aic": F.min("aic").over(w), "_bic": F.min("bic").over(w)})
    return rows.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("global_vaf") >= threshold, F.col(k))), F.max(k)).alias("k_vaf_global"),
        F.coalesce(F.min(F.when(F.col("aic") == F.col("_aic"), F.col(k))), F.max(k)).alias("k_aic"),
        F.coalesce(F.min(F.when(F.col("bic") == F.col("_bic"), F.col(k))), F.max(k)).alias("k_bic"),
        F.max("global_vaf").alias("best_global_vaf"))


def representatives(selected: DataFrame, keys: Sequence[str], median: DataFrame, by: str = "criterion", k: str = "selected_k") -> DataFrame:
    """Per class the row whose k is closest to the class median, first in key order on ties.

    ``median`` has (by, median_k).  Ranking is a partial aggregate, not a window.
    """
    d = selected.join(median, by).withColumn("_d", F.abs(F.col(k) - F.col("median_k")))
    best = d.groupBy(by).agg(F.min(F.struct("_d", *keys, k)).alias("_b"))
    return best.select(by, *[F.col(f"_b.{c}").alias(c) for c in keys], F.col(f"_b.{k}").alias(k))


def k_histogram(selected: DataFrame, by: str = "criterion", k: str = "selected_k") -> DataFrame:
    return selected.groupBy(k, by).agg(F.count(F.lit(1)).alias("n_tasks"))


def trajectory(summary: DataFrame, values: Sequence[str], k: str = "k") -> DataFrame:
    """Mean and standard error by k."""
    aggs = []
    for v in values:
        n = F.count(v)
        sem = F.when(n > 1, F.stddev_samp(v) / F.sqrt(F.when(n > 0, n).cast("double"))).otherwise(0.0)
        aggs += [F.avg(v).alias(f"{v}_mean"), sem.alias(f"{v}_sem"), n.alias(f"{v}_n")]
    return summary.groupBy(k).agg(*aggs)


def driver_frequency(stops: DataFrame, names: str = "worst_channels") -> DataFrame:
    """How often each channel was among the worst when a rule stopped."""
    return stops.select(F.explode(names).alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("n_stops"))


def best_per_key(summary: DataFrame, keys: Sequence[str], value: str = "global_vaf", k: str = "k") -> DataFrame:
    """Row with the largest value per key, lowest k on ties."""
    top = summary.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(k)).alias("_k"))).alias("_t"))
    return top.select(*keys, F.col(f"_t.{value}").alias(value), (-F.col("_t._k")).alias(k))


