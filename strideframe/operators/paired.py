"""Two-session pairing and the tests on the pairs. All tests of all metrics and groups run in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.functions.distributions import chi2_1_sf, normal_two_sided_p, t_quantile, t_two_sided_p
from strideframe.functions.numeric import EPS, div, finite
from strideframe.operators.ordered import TARGET_ROWS, row_index, running_weight, suffix_min
from strideframe.operators.quantiles import exact_quantile
from strideframe.session import stage


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide metric columns to long rows."""
    cols = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*ids, *cols).unpivot(list(ids), list(metrics), name, value)


def pair_sessions(df: DataFrame, keys: Sequence[str], session: str, values: Sequence[str], how: str = "mean",
                  labels: tuple = ("T0", "T1"), order: str | None = None) -> DataFrame:
    """One row per key with ``<value>_T0``, ``<value>_T1``, ``<value>_delta``, in one aggregation.

    ``mean`` averages several rows of a session, ``first`` takes the first non-null by ``order``.
    """
    aggs = []
    for v in values:
        for tag, label in zip(("T0", "T1"), labels):
            hit = F.when((F.col(session) == label) & finite(F.col(v)).isNotNull(), F.col(v).cast("double"))
            if how == "mean":
                agg = F.avg(hit)
            elif how == "first" and order:
                agg = F.min_by(hit, F.when(hit.isNotNull(), F.col(order)))
            else:
                raise ValueError("how must be 'mean', or 'first' with an order column")
            aggs.append(agg.alias(f"{v}_{tag}"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"{v}_delta": F.col(f"{v}_T1") - F.col(f"{v}_T0") for v in values})


def with_ratio(df: DataFrame, v: str, floor: float = EPS) -> DataFrame:
    """Add ``<v>_ratio`` = T1 / max(T0, floor)."""
    return df.withColumn(f"{v}_ratio", F.col(f"{v}_T1") / F.greatest(F.col(f"{v}_T0"), F.lit(floor)))


def paired_t(pairs: DataFrame, keys: Sequence[str], v0: str = "v0", v1: str = "v1", medians: bool = False,
             interval: str = "t") -> DataFrame:
    """Paired t report on complete pairs, T1 minus T0: means, sds, change, CI, t, df, p, dz, notes.

    ``interval`` is 't' (Student quantile) or 'z' (1.96).
    """
    a, b = finite(F.col(v0)), finite(F.col(v1))
    full = pairs.select(*keys, a.alias("v0"), b.alias("v1")).where("v0 is not null and v1 is not null")
    groups = pairs.select(*keys).distinct()
    agg = full.groupBy(*keys).agg(*_t_aggregates())
    if medians:
        for v, tag in (("v0", "median_T0"), ("v1", "median_T1")):
            agg = agg.join(exact_quantile(full, keys, v, 0.5, tag), list(keys))
    agg = groups.join(agg, list(keys), "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return _t_report(agg, ["median_T0", "median_T1"] if medians else [], interval)


def _t_aggregates() -> list[Column]:
    d = F.col("v1") - F.col("v0")
    return [F.count(F.lit(1)).alias("n_pairs"), F.avg("v0").alias("mean_T0"), F.stddev_samp("v0").alias("sd_T0"),
            F.avg("v1").alias("mean_T1"), F.stddev_samp("v1").alias("sd_T1"), F.avg(d).alias("mean_change"),
            F.stddev_samp(d).alias("sd_change")]


def _t_report(agg: DataFrame, extra: Sequence[str], interval: str) -> DataFrame:
    enough = F.col("n_pairs") >= 2
    varies = enough & (F.col("sd_change") >= EPS)
    stats = ["mean_T0", "sd_T0", "mean_T1", "sd_T1", "mean_change", "sd_change", *extra]
    agg = agg.withColumns({c: F.when(enough, F.col(c)) for c in stats})
    se = F.when(varies, F.col("sd_change") / F.sqrt(F.col("n_pairs").cast("double")))
    agg = agg.withColumns({
        "df": F.when(enough, (F.col("n_pairs") - 1).cast("double")),
        "t_stat": F.col("mean_change") / se,
        "effect_size_dz": F.when(varies, F.col("mean_change") / F.when(varies, F.col("sd_change"))),
        "notes": F.when(~enough, "too_few_pairs").when(~varies, "zero_variance_in_difference").otherwise(""),
    })
    agg = agg.withColumn("p_value", t_two_sided_p(F.col("t_stat"), F.col("df")))
    crit = t_quantile(F.col("df")) if interval == "t" else F.lit(1.96)
    return agg.withColumn("_half", crit * se).withColumns({
        "ci95_low": F.col("mean_change") - F.col("_half"), "ci95_high": F.col("mean_change") + F.col("_half")}).drop("_half")


def one_sample_p(df: DataFrame, keys: Sequence[str], delta: str, empty_p: float | None = 1.0) -> DataFrame:
    """Mean, dz and p of deltas against zero; fewer than two deltas gives ``empty_p``."""
    d = finite(F.col(delta))
    agg = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("_sd"))
    ok = (F.col("n") >= 2) & (F.col("_sd") > EPS)
    sd = F.when(ok, F.col("_sd"))
    t = F.col("mean_delta") / (sd / F.sqrt(F.col("n").cast("double")))
    p = t_two_sided_p(t, (F.col("n") - 1).cast("double"))
    return agg.select(*keys, "n", "mean_delta", (F.col("mean_delta") / sd).alias("effect_size_dz"),
                      F.when(F.col("n") < 2, F.lit(empty_p)).otherwise(p).alias("p_value"))


def _signed_rank_table(spark: SparkSession, n_max: int = 20) -> DataFrame:
    """P(W+ <= w) for n = 1..n_max without ties: counts of subset sums of 1..n over 2**n."""
    rows, counts = [], [1]
    for n in range(1, n_max + 1):
        longer = counts + [0] * n
        counts = [c + (longer[i - n] if i >= n else 0) for i, c in enumerate(longer)]
        total, below = 2**n, 0
        for w, c in enumerate(counts):
            below += c
            rows.append((n, w, below / total))
    return spark.createDataFrame(rows, "_n int, _w int, _cdf double")


def wilcoxon(pairs: DataFrame, keys: Sequence[str], v0: str = "v0", v1: str = "v1", exact_up_to: int = 20) -> DataFrame:
    """Two-sided signed-rank p: exact null up to ``exact_up_to`` pairs without zero differences, else normal.

    Differences are pre-aggregated by size, so ranks with ties follow from running counts.  Zeros are
    dropped; the normal variance carries the tie correction.
    """
    d = finite(F.col(v1)) - finite(F.col(v0))
    diffs = pairs.select(*keys, d.alias("_d")).where("_d is not null")
    sizes = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("_d") == 0).alias("_zeros"))
    tied = diffs.where("_d != 0").groupBy(*keys, F.abs("_d").alias("_a")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_d") > 0).alias("_pos"))
    ranked = running_weight(tied, keys, "_a", "_c").withColumn("_rank", F.col("before") + (F.col("_c") + 1) / 2)
    c = F.col("_c").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_c").cast("double").alias("_m"), F.sum(F.col("_rank") * F.col("_pos")).alias("w_plus"),
        F.sum(c * c * c - c).alias("_ties"))
    spark = pairs.sparkSession
    m, w = F.col("_m"), F.col("w_plus")
    top = m * (m + 1) / 2
    mean, var = m * (m + 1) / 4, (m * (m + 1) * (2 * m + 1) - F.col("_ties") / 2) / 24
    z = (F.least(w, top - w) - mean) / F.sqrt(F.when(var > 0, var))
    table = F.broadcast(_signed_rank_table(spark, exact_up_to))  # fixed size: about n_max**3 / 6 rows
    small = (F.col("n_pairs") <= exact_up_to) & (F.col("_zeros") == 0)
    out = sizes.join(sums, list(keys), "left").withColumns({
        "_n": F.when(small, m.cast("int")), "_w": F.when(small, F.floor(w).cast("int")),
        "_u": F.when(small, (top - F.floor(w)).cast("int")), "_z": z})
    # P(W+ >= w) equals P(W+ <= n(n+1)/2 - w) by symmetry
    out = out.join(table, ["_n", "_w"], "left").withColumnRenamed("_cdf", "_lower")
    out = out.join(table.withColumnRenamed("_w", "_u"), ["_n", "_u"], "left")
    exact = F.least(F.lit(1.0), 2 * F.least("_lower", "_cdf"))
    p = F.when(F.col("n_pairs") < 2, None).when(small, exact).otherwise(normal_two_sided_p(F.col("_z")))
    return out.select(*keys, "n_pairs", "w_plus", p.alias("p_wilcoxon"), small.alias("exact"))


def mcnemar(pairs: DataFrame, keys: Sequence[str], v0: str = "v0", v1: str = "v1", threshold: float | None = None) -> DataFrame:
    """Continuity-corrected McNemar on binary pairs with presence counts, phi and a 95 % interval.

    Values become 1 when above ``threshold``, or (no threshold) when they differ from the group's
    smallest value.
    """
    a, b = finite(F.col(v0)), finite(F.col(v1))
    full = pairs.select(*keys, a.alias("v0"), b.alias("v1")).where("v0 is not null and v1 is not null")
    if threshold is None:
        low = full.groupBy(*keys).agg(F.least(F.min("v0"), F.min("v1")).alias("_low"))
        full = full.join(low, list(keys)) if keys else full.withColumn("_low", low.scalar())
        one, two = F.col("v0") != F.col("_low"), F.col("v1") != F.col("_low")
    else:
        one, two = F.col("v0") > threshold, F.col("v1") > threshold
    return _mcnemar_report(full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), *_mcnemar_aggregates(one, two)))


def _mcnemar_aggregates(one: Column, two: Column, tag: str = "") -> list[Column]:
    return [F.count_if(one).alias(tag + "count_present_T0"), F.count_if(two).alias(tag + "count_present_T1"),
            F.count_if(~one & two).alias(tag + "b"), F.count_if(one & ~two).alias(tag + "c"), F.count_if(one & two).alias(tag + "both")]


def _mcnemar_report(agg: DataFrame) -> DataFrame:
    n = F.col("n_pairs").cast("double")
    p0, p1, bc = F.col("count_present_T0") / n, F.col("count_present_T1") / n, F.col("b") + F.col("c")
    chi2 = F.when(bc == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / F.when(bc != 0, bc))
    var = (p0 * (1 - p0) + p1 * (1 - p1) - 2 * (F.col("both") / n - p0 * p1)) / n
    se = F.when(var > EPS * EPS, F.sqrt(F.when(var > EPS * EPS, var)))
    ok = F.col("n_pairs") >= 2
    out = agg.withColumns({
        "count_absent_T0": F.col("n_pairs") - F.col("count_present_T0"), "count_absent_T1": F.col("n_pairs") - F.col("count_present_T1"),
        "mean_T0": F.when(ok, p0), "mean_T1": F.when(ok, p1), "mean_change": F.when(ok, p1 - p0), "chi2": F.when(ok, chi2),
        "ci95_low": F.when(ok, p1 - p0 - 1.96 * se), "ci95_high": F.when(ok, p1 - p0 + 1.96 * se)})
    return out.withColumns({
        "phi": F.sqrt(F.col("chi2") / F.col("n_pairs")),
        "p_value": F.when(bc == 0, F.when(ok, 1.0)).otherwise(chi2_1_sf(F.col("chi2")))}).drop("both")


def paired_tests(pairs: DataFrame, keys: Sequence[str], metric: str = "metric", v0: str = "v0", v1: str = "v1",
                 presence_marker: str = "_presence") -> DataFrame:
    """One row per key with the test the data call for: presence counts, McNemar for at most two distinct values, else t.

    ``metric`` is one of ``keys``; names containing ``presence_marker`` are tested as presence.
    """
    a, b = finite(F.col(v0)), finite(F.col(v1))
    full = pairs.select(*keys, a.alias("v0"), b.alias("v1")).where("v0 is not null and v1 is not null")
    ends = full.groupBy(*keys).agg(F.least(F.min("v0"), F.min("v1")).alias("_lo"), F.greatest(F.max("v0"), F.max("v1")).alias("_hi"))
    inner = (F.col("v0") > F.col("_lo")) & (F.col("v0") < F.col("_hi")) | (F.col("v1") > F.col("_lo")) & (F.col("v1") < F.col("_hi"))
    presence = F.lower(F.col(metric)).contains(presence_marker)
    cut = F.when(presence, 0.5).otherwise(F.col("_lo"))
    one, two = F.col("v0") > cut, F.col("v1") > cut
    agg = full.join(ends, list(keys)).groupBy(*keys).agg(
        *_t_aggregates(), F.count_if(inner).alias("_inner"), *[c for c in _mcnemar_aggregates(one, two)])
    agg = agg.withColumn("test_type", F.when(presence, "chi2").when(F.col("_inner") == 0, "mcnemar").otherwise("paired_t"))
    shared = ["n_pairs", "mean_T0", "mean_T1", "mean_change", "ci95_low", "ci95_high", "stat", "df", "p_value", "effect"]
    t = _t_report(agg, [], "t").withColumns({"stat": F.col("t_stat"), "effect": F.col("effect_size_dz")})
    t = t.select(*keys, "test_type", *[F.col(c).alias(f"_t_{c}") for c in shared], "count_present_T0", "count_present_T1", "b", "c", "both",
                 F.col("n_pairs"))
    m = _mcnemar_report(t).withColumns({"stat": F.col("chi2"), "effect": F.col("phi"), "df": F.lit(1.0)})
    is_t, is_presence = F.col("test_type") == "paired_t", F.col("test_type") == "chi2"
    m = m.withColumns({c: F.when(is_presence, None).otherwise(F.col(c)) for c in ("ci95_low", "ci95_high")})
    out = m.select(*keys, *[F.when(is_t, F.col(f"_t_{c}")).otherwise(F.col(c)).alias(c) for c in shared], "test_type")
    change = F.col("mean_change")
    return out.withColumn("direction", F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("none"))


def bh_fdr(stats: DataFrame, family: Sequence[str], p: str = "p_value", tie: Sequence[str] = (), out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q within each family (NULL is a family of its own); NULL p keeps NULL q.

    The statistics table (one row per test) is read several times, so it is staged.  A window ranks each family; only a
    table of more rows than a slice should have is ranked slice by slice.
    """
    stats = stage(stats)
    fam = F.to_json(F.struct(*family), {"ignoreNullFields": "false"}) if family else F.lit("all")
    marked = stats.withColumn("_fam", fam)
    if stats.count() <= TARGET_ROWS:
        whole = W.partitionBy("_fam")
        order = whole.orderBy(F.col(p).asc_nulls_last(), *tie)
        marked = marked.withColumn("_raw", F.col(p) * F.count(p).over(whole) / F.row_number().over(order))
        least = F.least(F.min("_raw").over(order.rowsBetween(0, W.unboundedFollowing)), F.lit(1.0))
        return marked.withColumn(out, F.when(F.col(p).isNotNull(), least)).select(*stats.columns, out)
    tested = marked.where(F.col(p).isNotNull()).withColumnsRenamed({"n": "_n", "idx": "_idx"})
    ranked = row_index(tested, ["_fam"], p, tie, keep_cell=True)
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("n") / (F.col("idx") + 1))
    q = suffix_min(ranked, ["_fam"], ["idx"], "_raw", out).withColumn(out, F.least(F.col(out), F.lit(1.0)))
    q = q.drop(*[c for c in ("n", "idx") if f"_{c}" in q.columns]).withColumnsRenamed({"_n": "n", "_idx": "idx"})
    rest = marked.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    cols = [*stats.columns, out]
    return q.select(*cols).unionByName(rest.select(*cols))


def stats_row(stats: DataFrame, **wanted: str) -> DataFrame:
    """Rows of a statistics table that match every given column value."""
    for c, v in wanted.items():
        stats = stats.where(F.col(c) == v)
    return stats


def significance_panel(effects: DataFrame, p: str = "p_value", effect: str = "effect_size_dz", better_down: Sequence[str] = (),
                       metric: str = "metric", alpha: float = 0.05, gate: Mapping[str, float] | None = None) -> DataFrame:
    """Effect sizes signed so that + means improvement, with a significance flag.

    ``gate`` maps metric -> p of an outer test that must also be below ``alpha``.
    """
    flip = F.when(F.col(metric).isin(*better_down), -1.0).otherwise(1.0) if better_down else F.lit(1.0)
    sig = F.coalesce(F.col(p) < alpha, F.lit(False))
    if gate:
        table = F.create_map(*[F.lit(x) for kv in gate.items() for x in kv])
        sig = sig & (F.coalesce(F.try_element_at(table, F.col(metric)), F.lit(0.0)) < alpha)
    return effects.withColumn("improvement", F.col(effect) * flip).withColumn("significant", sig)
