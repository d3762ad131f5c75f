"""Epochs rejected by peak-to-peak thresholds that cross-validation picks for every channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import row_index
from strideframe.operators.quantiles import exact_quantile
from strideframe.session import stage


def peak_to_peak(samples: DataFrame, keys: Sequence[str], epoch: str = "epoch", v: str = "v") -> DataFrame:
    """keys, epoch and ptp: the range of the values of an epoch."""
    return samples.where(F.col(v).isNotNull()).groupBy(*keys, epoch).agg((F.max(v) - F.min(v)).alias("ptp"))


def candidate_thresholds(ranges: DataFrame, keys: Sequence[str], candidates: int = 10, epoch: str = "epoch") -> DataFrame:
    """keys and thresholds: the ranges at the ranks that cut a key's epochs into ``candidates`` parts, distinct and ascending."""
    ranked = row_index(ranges, keys, "ptp", [epoch])
    part = F.floor(F.col("idx") * candidates / F.col("n"))
    tops = ranked.groupBy(*keys, part.alias("_part")).agg(F.max("ptp").alias("ptp"))
    return tops.groupBy(*keys).agg(F.sort_array(F.collect_set("ptp")).alias("thresholds"))


def rejection_thresholds(samples: DataFrame, keys: Sequence[str], pos: str = "pos", epoch: str = "epoch", v: str = "v", folds: int = 5, candidates: int = 10,
                         fold: Column | None = None) -> DataFrame:
    """keys, threshold, error, n_epochs and n_rejected: the peak-to-peak threshold of every key (a channel of a recording).

    ``samples`` has a value for every position of an epoch; null values are left out.  For every fold and candidate the mean
    course of the other folds' epochs within the threshold is held against the median course of the fold's own epochs; the
    error of a candidate is the root mean square of the differences over positions, averaged over folds.  The smallest
    error wins, of equal ones the lower threshold.  Means of all (fold, candidate) come from one aggregation by fold,
    smallest candidate that an epoch passes, and position, so samples are not multiplied.  ``fold`` numbers the epochs'
    folds from 0; by default a hash of the epoch.  A key without two folds has a null threshold and rejects nothing.
    """
    samples = samples.where(F.col(v).isNotNull())
    number = F.pmod(F.xxhash64(epoch), F.lit(folds)) if fold is None else fold
    ranges = stage(peak_to_peak(samples, keys, epoch, v))
    cuts = stage(candidate_thresholds(ranges, keys, candidates, epoch))
    passed = F.size(F.filter("thresholds", lambda x: x < F.col("ptp"))) + 1
    marks = ranges.join(cuts, list(keys)).select(*keys, epoch, number.cast("int").alias("_fold"), passed.alias("_from"))
    rows = stage(samples.select(*keys, epoch, pos, v).join(marks, [*keys, epoch]))
    cells = rows.groupBy(*keys, "_fold", "_from", pos).agg(F.sum(v).alias("_s"), F.count(F.lit(1)).alias("_c"))
    upto = cells.join(cuts, list(keys)).withColumn("_j", F.explode(F.sequence(F.col("_from"), F.size("thresholds")))).drop("thresholds")
    own = stage(upto.groupBy(*keys, "_j", pos, "_fold").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")))
    whole = own.groupBy(*keys, "_j", pos).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    middle = exact_quantile(rows, [*keys, "_fold", pos], v, 0.5, "_m")
    both = middle.join(whole, [*keys, pos]).join(own, [*keys, "_j", pos, "_fold"], "left")
    n = F.col("_tc") - F.coalesce("_c", F.lit(0))
    mean = F.when(n > 0, (F.col("_ts") - F.coalesce("_s", F.lit(0.0))) / n)
    by_fold = both.groupBy(*keys, "_j", "_fold").agg(F.sqrt(F.avg(F.pow(mean - F.col("_m"), 2))).alias("_e"))
    scores = by_fold.groupBy(*keys, "_j").agg(F.avg("_e").alias("error")).where("error is not null")
    best = scores.groupBy(*keys).agg(F.min(F.struct("error", "_j")).alias("_b"))
    chosen = cuts.join(best, list(keys), "left").select(*keys, F.expr("try_element_at(thresholds, _b._j)").alias("threshold"), F.col("_b.error").alias("error"))
    counts = ranges.join(chosen, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_epochs"), F.count(F.when(F.col("ptp") > F.col("threshold"), 1)).alias("n_rejected"))
    return chosen.join(counts, list(keys))


def epoch_marks(samples: DataFrame, thresholds: DataFrame, recording: Sequence[str], channel: str = "channel", epoch: str = "epoch", v: str = "v", consensus: float = 0.4) -> DataFrame:
    """recording, epoch, n_channels, n_bad and rejected: an epoch goes when more than ``consensus`` of its channels exceed their thresholds."""
    keys = [*recording, channel]
    ranges = peak_to_peak(samples, keys, epoch, v).join(thresholds.select(*keys, "threshold"), keys, "left")
    out = ranges.groupBy(*recording, epoch).agg(F.count(F.lit(1)).alias("n_channels"), F.count(F.when(F.col("ptp") > F.col("threshold"), 1)).alias("n_bad"))
    return out.withColumn("rejected", F.col("n_bad") > F.col("n_channels") * consensus)
