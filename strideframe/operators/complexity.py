"""Order-aware shape features per key: roughness, lag-1 autocorrelation, permutation entropy."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.functions.numeric import EPS, div
from strideframe.operators.ordered import TARGET_ROWS, adjacent_pairs, blocks, row_index

BLOCK_ROWS = 65_536


def roughness(df: DataFrame, keys: Sequence[str], order: str, v: str = "v", tie: Sequence[str] = (),
              target_rows: int = TARGET_ROWS) -> DataFrame:
    """rms_derivative and lag1_autocorr of the z-scored signal.

    Both are scale free, so they follow from sums over consecutive pairs and the key's moments; no
    z-scored copy of the data is needed.  n < 3 gives NULL, a constant signal gives (0, NULL).
    """
    base = df.groupBy(*keys).agg(
        F.count(v).alias("_n"), F.avg(v).alias("_mu"), F.stddev_samp(v).alias("_sd"), F.var_pop(v).alias("_vp"))
    p, c = F.col(f"prev.{v}"), F.col(f"cur.{v}")
    sums = adjacent_pairs(df, keys, order, tie, [v], target_rows).groupBy(*keys).agg(
        F.sum((c - p) * (c - p)).alias("_dd"), F.sum(p * c).alias("_pc"), F.sum(p).alias("_p"), F.sum(c).alias("_c"),
        F.sum(p * p).alias("_pp"))
    j = base.join(sums, list(keys), "left")
    n, mu, sd = F.col("_n"), F.col("_mu"), F.col("_sd")
    m = n - 1
    cross = F.col("_pc") - mu * (F.col("_p") + F.col("_c")) + m * mu * mu
    own = F.col("_pp") - 2 * mu * F.col("_p") + m * mu * mu
    enough, varies = n >= 3, sd >= EPS
    c0 = div(own, sd * sd * m)
    rms = F.when(varies, F.sqrt(div(F.col("_dd"), m * sd * sd) + EPS)).otherwise(F.lit(0.0))
    return j.select(*keys, F.when(enough, rms).alias("rms_derivative"),
                    F.when(enough & varies & (c0 >= EPS), div(cross, own)).alias("lag1_autocorr"))


def permutation_entropy(df: DataFrame, keys: Sequence[str], order: str, v: str = "v", tie: Sequence[str] = (),
                        target_rows: int = TARGET_ROWS, include_last: bool = False) -> DataFrame:
    """Normalised permutation entropy of order 3, delay 1; fewer than six samples gives no row.

    The final embedding is dropped unless ``include_last``; ties count as ascending.
    """
    rows = blocks(row_index(df.select(*dict.fromkeys([*keys, order, *tie, v])), keys, order, tie, target_rows), BLOCK_ROWS, after=2)
    w = W.partitionBy(*keys, "block").orderBy("idx")
    a, b, c = F.col(v), F.lead(v, 1).over(w), F.lead(v, 2).over(w)
    code = 4 * (a <= b).cast("int") + 2 * (b <= c).cast("int") + (a <= c).cast("int")
    tail = 2 if include_last else 3
    emb = rows.withColumn("_code", code).where(F.col("core") & (F.col("n") >= 6) & (F.col("idx") + tail < F.col("n")))
    counts = emb.groupBy(*keys, "_code").agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(W.partitionBy(*keys))
    p = F.col("_c") / total
    return counts.withColumn("_h", p * F.log2(p)).groupBy(*keys).agg(
        (F.abs(F.sum("_h")) / math.log2(6)).alias("permutation_entropy"))
