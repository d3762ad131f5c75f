"""Six amplitude-free features per cycle, and their means over cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.numeric import EPS, div
from strideframe.operators.complexity import permutation_entropy, roughness
from strideframe.operators.ordered import TARGET_ROWS
from strideframe.operators.quantiles import exact_quantile
from strideframe.operators.spectral import feature_segment, spectral_features, welch

FEATURES = ["cycle_duration_s", "dominant_frequency_hz", "spectral_entropy", "normalized_rms_derivative", "lag1_autocorr",
            "permutation_entropy"]


def cycle_features(df: DataFrame, keys: Sequence[str], t: str = "t", v: str = "v", tie: Sequence[str] = (), fs: float = 1.0,
                   target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per key (recording, sensor, axis, cycle) with at least two samples and a positive span."""
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), (F.max(t) - F.min(t)).alias("cycle_duration_s")).where(
        (F.col("n_samples") >= 2) & (F.col("cycle_duration_s") > 0))
    rough = roughness(df, keys, t, v, tie, target_rows).withColumnRenamed("rms_derivative", "normalized_rms_derivative")
    # the spectrum of the z-scored signal is the raw spectrum over the variance
    psd = welch(df, keys, t, feature_segment, v, tie, fs, target_rows=target_rows)
    var = df.groupBy(*keys).agg(F.var_samp(v).alias("_var"))
    psd = psd.join(var, list(keys)).withColumn("power", F.coalesce(div(F.col("power"), F.col("_var"), EPS**2), F.col("power")))
    spec = spectral_features(psd, keys)
    pe = permutation_entropy(df, keys, t, v, tie, target_rows)
    out = base
    for part in (rough, spec, pe):
        out = out.join(part, list(keys), "left")
    return out.select(*keys, "n_samples", *FEATURES)


def aggregate_cycles(features: DataFrame, keys: Sequence[str], min_cycles: int = 2) -> DataFrame:
    """Mean of each feature over cycles, NULL below ``min_cycles``, with counts, durations and the reason.

    ``n_valid`` counts cycles with at least one feature beyond the duration.
    """
    usable = F.coalesce(*[F.col(f) for f in FEATURES[1:]]).isNotNull()
    enough = F.col("n_valid") >= min_cycles
    agg = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if(usable).alias("n_valid"),
        F.min("cycle_duration_s").alias("min_duration_s"), F.max("cycle_duration_s").alias("max_duration_s"),
        *[F.avg(f).alias(f) for f in FEATURES])
    med = exact_quantile(features, keys, "cycle_duration_s", 0.5, "median_duration_s")
    reason = F.when(~enough, F.format_string("too_few_cycles (n=%d < min=%d)", F.col("n_valid"), F.lit(min_cycles)))
    return agg.join(med, list(keys), "left").select(
        *keys, "n_segments", "n_valid", (F.col("n_segments") - F.col("n_valid")).alias("n_discarded"),
        "median_duration_s", "min_duration_s", "max_duration_s", reason.alias("exclusion_reason"),
        *[F.when(enough, F.col(f)).alias(f) for f in FEATURES])
