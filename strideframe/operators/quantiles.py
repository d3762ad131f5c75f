"""Exact linear-interpolated quantiles without collecting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import running_weight

#: A task's sketches have some 100 bytes for each unit of accuracy and group; the bracket has 6/ACCURACY of a group's rows.
ACCURACY = 2_000


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, accuracy: int = ACCURACY) -> DataFrame:
    """Per-key quantile equal to the sorted-array definition: position (n-1)*q, linear between ranks.

    A mergeable sketch brackets the wanted ranks; only rows inside the bracket are shuffled, after
    being pre-aggregated by value, and ranked exactly, in slices (`running_weight`) if they are many.  Groups up to
    ``accuracy`` rows use [min, max] as the bracket; a larger group sends about 6/accuracy of its rows to the ranking.
    NULL values are ignored; keys with no value are absent from the result.
    """
    slack = 3.0 / accuracy
    groups = list(keys) or ["_all"]
    data = (df if keys else df.withColumn("_all", F.lit(1))).where(F.col(value).isNotNull())
    data = data.select(*groups, F.col(value).cast("double").alias("_v"))
    probe = F.percentile_approx("_v", [max(q - slack, 0.0), min(q + slack, 1.0)], accuracy)
    brackets = data.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), probe.alias("_p")
    )
    small = F.col("_n") <= accuracy
    brackets = brackets.select(
        *groups,
        "_n",
        F.when(small | F.lit(q <= slack), F.col("_mn")).otherwise(F.col("_p")[0]).alias("_lo"),
        F.when(small | F.lit(q >= 1 - slack), F.col("_mx")).otherwise(F.col("_p")[1]).alias("_hi"),
    )
    pooled = data.join(brackets, groups).withColumn("_below", F.col("_v") < F.col("_lo"))
    spot = F.when(F.col("_below"), F.col("_lo")).otherwise(F.col("_v"))
    counts = (
        pooled.where(F.col("_v") <= F.col("_hi"))
        .groupBy(*groups, "_n", spot.alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"), F.count_if("_below").alias("_skip"))
    )
    # the bracket's lowest value also carries the count of everything below it
    ranked = running_weight(counts, groups, "_x", "_c")
    pos = (F.col("_n") - 1) * F.lit(float(q))
    lo_rank, hi_rank = F.floor(pos), F.ceil(pos)
    first = F.col("before") + F.col("_skip")
    last = F.col("before") + F.col("_c") - 1

    def at(rank):
        return F.max(F.when((first <= rank) & (rank <= last), F.col("_x")))

    picked = ranked.groupBy(*groups, "_n").agg(at(lo_rank).alias("_a"), at(hi_rank).alias("_b"))
    frac = pos - lo_rank
    checked = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("quantile bracket missed its rank")))
    return picked.select(*keys, checked.otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * frac).cast("double").alias(out))
