"""Signal features, segments and phase grids over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import segments as S
from strideframe.operators import signals as G
from strideframe.operators.quantiles import exact_quantile
from strideframe.plans.registry import SIGNAL_CTE, query, rounded, signals, table
from strideframe.session import stage

KEYS = ["entity", "channel"]


@query("signal_auc_timing", f"""
WITH {SIGNAL_CTE},
k AS (SELECT entity, channel, min(t) t0, max(t) t1, max(v) peak FROM s GROUP BY 1, 2),
w AS (SELECT s.*, t0, t1, peak, lag(t) OVER o AS pt, lag(v) OVER o AS pv,
      CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) END AS ph
      FROM s JOIN k USING (entity, channel) WINDOW o AS (PARTITION BY entity, channel ORDER BY t, sample))
SELECT entity, channel, count(v) AS n, round(avg(v), 6) AS mean_amp, max(v) AS peak_amp,
  round(sum((t - pt) * (v + pv) / 2) / max(t1 - t0), 6) AS auc,
  round(min(CASE WHEN peak > 1e-12 AND v >= 0.1 * peak THEN ph END), 6) AS onset,
  round(max(CASE WHEN peak > 1e-12 AND v >= 0.1 * peak THEN ph END), 6) AS "offset",
  round(max(CASE WHEN peak > 1e-12 AND v >= 0.1 * peak THEN ph END)
      - min(CASE WHEN peak > 1e-12 AND v >= 0.1 * peak THEN ph END), 6) AS duration,
  round(CASE WHEN sum(v) > 1e-12 THEN sum(ph * v) / sum(v) END, 6) AS centroid,
  round(max(t1 - t0), 6) AS cycle_duration_s
FROM w GROUP BY 1, 2 HAVING max(t1) > max(t0)""")
def signal_auc_timing(spark, sf):
    return rounded(G.amplitude_timing(signals(spark, sf), KEYS, tie=["sample"]))


_GRID_SQL = f"""
WITH {SIGNAL_CTE},
k AS (SELECT entity, channel, min(t) t0, max(t) t1 FROM s GROUP BY 1, 2 HAVING max(t) > min(t)),
p AS (SELECT entity, channel, (t - t0) / (t1 - t0) AS ph, v,
      lead((t - t0) / (t1 - t0)) OVER o AS nph, lead(v) OVER o AS nv
      FROM s JOIN k USING (entity, channel) WINDOW o AS (PARTITION BY entity, channel ORDER BY t, sample)),
g AS (SELECT i AS phase_idx, i / 100.0 AS phase FROM range(101) r(i))
SELECT entity, channel, CAST(phase_idx AS INTEGER) AS phase_idx, round(CAST(phase AS DOUBLE), 6) AS phase,
  round(%s, 6) AS v
FROM g JOIN p ON ph <= phase AND (nph IS NULL OR phase < nph)"""


@query("phase_grid_linear", _GRID_SQL % "CASE WHEN nph IS NULL THEN v ELSE v + (nv - v) * (phase - ph) / (nph - ph) END")
def phase_grid_linear(spark, sf):
    return rounded(S.phase_grid(signals(spark, sf), KEYS, tie=["sample"]))


@query("phase_grid_asof", _GRID_SQL % "v")
def phase_grid_asof(spark, sf):
    return rounded(S.phase_grid(signals(spark, sf), KEYS, tie=["sample"], mode="asof"))


@query("phase_grid_median", f"""
WITH {SIGNAL_CTE}, c AS (SELECT entity, channel, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 10),
m AS (SELECT entity, greatest(10, CAST(floor(median(n)) AS INTEGER)) AS points FROM c GROUP BY 1),
k AS (SELECT entity, channel, min(t) t0, max(t) t1 FROM s GROUP BY 1, 2 HAVING max(t) > min(t)),
p AS (SELECT entity, channel, (t - t0) / (t1 - t0) AS ph, v, lead((t - t0) / (t1 - t0)) OVER o AS nph, lead(v) OVER o AS nv
  FROM s JOIN k USING (entity, channel) JOIN c USING (entity, channel) WINDOW o AS (PARTITION BY entity, channel ORDER BY t, sample)),
g AS (SELECT p.*, points, CAST(i AS INTEGER) AS phase_idx, i / (points - 1.0) AS phase FROM p JOIN m USING (entity), range(1000) r(i) WHERE i < points)
SELECT entity, channel, points, phase_idx, round(CAST(phase AS DOUBLE), 6) AS phase, round(CASE WHEN nph IS NULL THEN v ELSE v + (nv - v) * (phase - ph) / (nph - ph) END, 6) AS v
FROM g WHERE ph <= phase AND (nph IS NULL OR phase < nph)""")
def phase_grid_median(spark, sf):
    """Event types as the cycles of a user; the grid is as long as the median cycle."""
    cycles = S.median_points(signals(spark, sf), ["entity"], ["channel"])
    return rounded(S.phase_grid(cycles, KEYS, tie=["sample"], points="points"))


@query("curve_band", f"""
WITH curves AS ({_GRID_SQL % "CASE WHEN nph IS NULL THEN v ELSE v + (nv - v) * (phase - ph) / (nph - ph) END"})
SELECT channel, phase_idx, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(median(v), 4) AS median,
  count(DISTINCT entity) AS n_subjects
FROM curves GROUP BY 1, 2""")
def curve_band(spark, sf):
    curves = stage(rounded(S.phase_grid(signals(spark, sf), KEYS, tie=["sample"])))
    band = curves.groupBy("channel", "phase_idx").agg(  # a grid has each point of an entity once
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("entity").alias("n_subjects"))
    medians = exact_quantile(curves, ["channel", "phase_idx"], "v", 0.5, "median")
    return rounded(band.join(medians, ["channel", "phase_idx"]), 4)


SEGMENT_CTE = """seg AS (SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY t, sample) - 1 AS INTEGER) AS cycle_index,
      t AS start_s, lead(t) OVER (PARTITION BY entity ORDER BY t, sample) AS end_s FROM s WHERE channel = 'signup'
      QUALIFY end_s IS NOT NULL)"""


def signup_segments(spark, sf):
    return S.consecutive_segments(signals(spark, sf).where("channel = 'signup'"), ["entity"], "t", ["sample"])


@query("segment_join", f"""
WITH {SIGNAL_CTE}, {SEGMENT_CTE}
SELECT entity, cycle_index, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, count(*) AS n_samples,
  round(avg(v), 6) AS mean_v, max(v) AS max_v
FROM s JOIN seg USING (entity) WHERE t BETWEEN start_s AND end_s GROUP BY ALL""")
def segment_join(spark, sf):
    joined = S.samples_in_segments(signals(spark, sf), signup_segments(spark, sf), ["entity"])
    out = joined.groupBy("entity", "cycle_index", "start_s", "end_s").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("v").alias("mean_v"), F.max("v").alias("max_v"))
    return rounded(out)


@query("segment_mask", f"""
WITH {SIGNAL_CTE}, {SEGMENT_CTE}
SELECT channel, count(*) AS n_inside, count(DISTINCT entity) AS n_entities, round(sum(v), 2) AS sum_v
FROM s WHERE EXISTS (SELECT 1 FROM seg WHERE seg.entity = s.entity AND s.t BETWEEN start_s AND end_s) GROUP BY 1""")
def segment_mask(spark, sf):
    kept = S.samples_in_any_segment(signals(spark, sf), signup_segments(spark, sf), ["entity"])
    return rounded(kept.groupBy("channel").agg(F.count(F.lit(1)).alias("n_inside"),
                                               F.count_distinct("entity").alias("n_entities"), F.sum("v").alias("sum_v")), 2)


@query("time_crop", f"""
WITH {SIGNAL_CTE}
SELECT channel, count(*) AS n, round(min(t), 3) AS t_first, round(max(t), 3) AS t_last
FROM s WHERE t BETWEEN 432000 AND 864000 GROUP BY 1""")
def time_crop(spark, sf):
    cropped = S.require_rows(S.crop(signals(spark, sf), "t", 432000, 864000), "no samples in the requested time window")
    return rounded(cropped.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"),
                                                  F.max("t").alias("t_last")), 3)


@query("scale_p99", """
WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.99) AS scale FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(scale, 4) AS scale, count(*) AS n, round(avg(l_extendedprice / scale), 6) AS mean_scaled,
  count(*) FILTER (l_extendedprice / scale > 1) AS n_above
FROM lineitem JOIN q USING (l_returnflag, l_linestatus) GROUP BY ALL""")
def scale_p99(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("v"))
    keys = ["l_returnflag", "l_linestatus"]
    scale = G.channel_scale(rows, keys)
    scaled = G.apply_scale(rows, scale, keys)
    out = scaled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_scaled"), F.count_if(F.col("v") > 1).alias("n_above"))
    return out.join(scale, keys).select(*keys, F.round("scale", 4).alias("scale"), "n", F.round("mean_scaled", 6).alias("mean_scaled"), "n_above")
